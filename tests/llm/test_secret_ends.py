import base64
import random

import pytest

from dendrica.llm import secret_scan


def field(x):
    return len(x).to_bytes(4, "big") + x


def der(n):
    """A DER key of n bytes, 40 to 120."""
    return b"\x30" + bytes([n - 2]) + b"\x02\x01\x00\x04" + bytes([n - 7]) + bytes(range(n - 7))


ED = base64.b64encode(field(b"ssh-ed25519") + field(bytes(range(32)))).decode()
RSA = base64.b64encode(field(b"ssh-rsa") + field(b"\1\0\1") + field(bytes(range(1, 130)) * 2)).decode()
DER = base64.b64encode(der(57)).decode()
PRIVATE = base64.b64encode(secret_scan.OPENSSH + field(b"none") * 2 + field(b"") + (1).to_bytes(4, "big") + field(bytes(51)) + field(bytes(74))).decode()


def wrapped(x, width=64):
    return "\n".join(x[i : i + width] for i in range(0, len(x), width))


@pytest.mark.parametrize("key, kind", [(ED, "ssh"), (DER, "der"), (wrapped(DER, 40), "der"), (wrapped(RSA), "ssh"), (wrapped(RSA, 24 * 2), "ssh"), (wrapped(PRIVATE), "ssh")])
@pytest.mark.parametrize("after", ["", "\nThe next line", "\r\nnext", "\n\nThe next", " me@host\nThe", "\n" + "word" * 20 + "\nThe"])
@pytest.mark.parametrize("before", ["", "ssh-ed25519 ", "Key\n", "word" * 20 + "\n", "é ", "x", "key", "MA", "Zz/+9"])
def test_key_ends_where_its_lengths_say(key, kind, after, before):
    assert "=" not in ED + DER
    text = before + key + after
    assert [s for s in secret_scan.spans_of(text) if s[2] in ("der", "ssh")] == [(len(before), len(before + key), kind)]


def test_every_key_of_a_list_is_found():
    text = "\n".join([f"ssh-ed25519 {ED}"] * 3)
    assert [s[2] for s in secret_scan.spans_of(text)] == ["ssh"] * 3
    bare = "\n".join([ED, DER, ED])
    assert [bare[a:b] for a, b, _ in secret_scan.spans_of(bare)] == [ED, DER, ED]
    assert secret_scan.spans_of("\n".join([ED[:-4], DER[4:], "M" * 64, "A" * 64])) == []


def plain_keys(run):
    """Keys of a run of base64 lines: every place, every end of a line, decoded whole; the first place wins, then the last end for ssh."""
    lines, at, places = run.split("\n"), 0, []
    for line in lines:
        places.append((at, at + len(line)))
        at += len(line) + 1
    out, done = [], 0
    for low, high in places:
        for start in range(low, high - 39):
            if start < done:
                continue
            for end in [e for _, e in reversed(places) if e - start >= 40 and e >= high]:
                raw = secret_scan._decoded(run[start:end].replace("\n", ""))
                exact = -(-4 * len(raw) // 3) == len(run[start:end].replace("\n", ""))
                if exact and raw[:1] == b"\x30" and secret_scan.der_ends(raw):
                    out.append((start, end, "der"))
                elif exact and len(e := secret_scan.ssh_ends(raw)) and e[-1] == len(raw):
                    out.append((start, end, "ssh"))
                else:
                    continue
                done = end
                break
    return out


def test_keys_against_every_place_and_end():
    rng = random.Random(11)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    noise = lambda n: "".join(rng.choice(letters) for _ in range(n))
    whole = base64.b64encode(field(b"ssh-rsa") + field(b"\1\0\1") + field(bytes(range(1, 131)) * 2)).decode()
    assert "=" not in whole
    found = 0
    for _ in range(300):
        parts = [rng.choice([ED, DER, wrapped(DER, 40), wrapped(whole), noise(rng.randint(1, 90)), noise(rng.randint(1, 5)) + ED, noise(3) + wrapped(DER, 44), ED[:-4], DER[5:]]) for _ in range(rng.randint(1, 4))]
        run = noise(40) + "\n" + "\n".join(parts)
        want = plain_keys(run)
        found += len(want)
        assert secret_scan.keys_of(run) == want
    assert found > 150


def test_hex_keys_and_tokens_behind_letters():
    key = der(60).hex()
    for before in ("", "a", "0", "30", "x "):
        text = before + key + " end"
        assert [s for s in secret_scan.spans_of(text) if s[2] == "der"] == [(len(before), len(before + key), "der")]
    head = base64.urlsafe_b64encode(b'{"alg":"HS256"}').decode().rstrip("=")
    token = f"{head}.e30.c2ln"
    for before in ("", "x", "eyJ", "eyJx"):
        assert [s for s in secret_scan.spans_of(before + token) if s[2] == "jwt"] == [(len(before), len(before + token), "jwt")]


def plain_base(text):
    """Base spans by a scan of characters."""
    letters, out = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", []
    low = "".join(c.lower() if c in letters else c for c in text)
    value = set(letters + "0123456789+/_.=-")
    i = 0
    while i < len(text):
        end = 0
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low.startswith(name, i):
                j = i + len(name)
                j += text[j : j + 1] in ("\"", "'")
                while text[j : j + 1] == " ":
                    j += 1
                if text[j : j + 1] in (":", "="):
                    j += 1
                    while text[j : j + 1] == " ":
                        j += 1
                    j += text[j : j + 1] in ("\"", "'")
                    k = j
                    while k < len(text) and text[k] in value:
                        k += 1
                    if k > j:
                        end = k
                        out += [(i, k, "assign")] if k - j >= 6 else []
                        break
        i = end or i + 1
    for kind, first, more, least in (("access", "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20), ("hex", "", set("0123456789abcdef"), 24)):
        i = 0
        while i < len(text):
            k = i + len(first)
            while text.startswith(first, i) and k < len(text) and text[k] in more:
                k += 1
            if k > i + len(first):
                out += [(i, k, kind)] if k - i >= least else []
                i = k
            else:
                i += 1
    return sorted(out, key=lambda s: (s[0], secret_scan.KINDS.index(s[2])))


def test_base_spans_and_query_against_brute_force(spark):
    import hashlib

    from dendrica.llm import queries

    rng = random.Random(5)
    bits = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "apiKey", "\"", "'", " ", "  ", ":", "=", "abc123", "x" * 7, "AKIA", "AKIA" + "Q7" * 8, "é", "ſecret", "ab12" * 6, "\n", "-", "_"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        assert [s for s in secret_scan.spans_of(text) if s[2] in secret_scan.BASE] == plain_base(text)
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op3_secret_scan(spark, sf).collect():
        spans = plain_base(texts[r.doc_id] or "")
        said = ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
        count = [sum(k == kind for *_, k in spans) for kind in secret_scan.BASE]
        assert ([r.n_assign, r.n_access, r.n_hex], r.base_sha256) == (count, hashlib.sha256(said.encode()).hexdigest())

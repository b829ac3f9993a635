"""Secret scan: base spans against a scan without patterns, and labelled keys and identifiers for the novelty measure."""

import random
import string
import time

import pytest

from wayframe.llm import secrets

VALUE = set(string.ascii_letters + string.digits + "+/_.=-")
NAMES = ["password", "passwd", "secret", "token", "api_key", "apikey"]


def run_of(text, at, kinds):
    end = at
    while end < len(text) and text[end] in kinds:
        end += 1
    return end


def assigned(text, at):
    """End of name, quote, spaces, sign, spaces, quote and value at a place, with the value's length; None if there is none."""
    lower = "".join(c.lower() if c in string.ascii_letters else c for c in text)
    for name in NAMES:  # no name begins another but apikey and api_key, which differ
        if not lower.startswith(name, at):
            continue
        for quoted in (1, 0):
            k = at + len(name)
            if quoted:
                if text[k : k + 1] not in ("'", '"'):
                    continue
                k += 1
            k = run_of(text, k, " ")
            if text[k : k + 1] not in (":", "="):
                continue
            k = run_of(text, k + 1, " ")
            k += text[k : k + 1] in ("'", '"') and text[k : k + 1] != ""
            end = run_of(text, k, VALUE)
            if end > k:
                return end, end - k
    return None


def base(text):
    out, at = [], 0
    while at < len(text):
        found = assigned(text, at)
        if found and found[1] >= 6:
            out.append((at, found[0], "assign"))
        at = found[0] if found else at + 1
    for name, head, kinds, least in (("access", "AKIA", set(string.ascii_uppercase + string.digits), 20), ("hex", "", set("0123456789abcdef"), 24)):
        at = 0
        while at < len(text):
            end = run_of(text, at + len(head), kinds) if text.startswith(head, at) else at
            if end <= at + len(head):
                at += 1
                continue
            if end - at >= least:
                out.append((at, end, name))
            at = end
    return out


def test_base_spans_without_patterns():
    rng = random.Random(4)
    parts = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", "'", '"', " ", "  ", ":", "=", "abc", "x.y=z-1", "AKIA", "AKIA" + "A1" * 8, "0f" * 12, "0f" * 11, "ſecret", "é", "K", "\n", "+/", "9"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert secrets.listed(secrets.base_spans(text)) == secrets.listed(base(text)), repr(text)


def labelled(seed=11):
    """Random keys, and identifiers of which a quarter of the words aren't in the dictionary."""
    rng = random.Random(seed)
    known = [w for w in secrets._IDENTIFIERS.split() if w.isalpha() and 2 < len(w) < 20]
    odd = "flux manifold telemetry quantum avocado giraffe thermostat astronomy barometer plywood velvet harbour".split()
    word = lambda: rng.choice(odd if rng.random() < 0.25 else known)
    some = lambda kinds, a, b: "".join(rng.choice(kinds) for _ in range(rng.randint(a, b)))
    keys = [some(string.ascii_letters + string.digits, 12, 40) for _ in range(150)] + [some(string.ascii_letters, 20, 32) for _ in range(50)]
    keys += [some(string.digits + "abcdef", 16, 23) for _ in range(50)] + [some(string.ascii_letters + string.digits + "+/", 20, 44) + "=" for _ in range(50)]
    names = ["".join(word().capitalize() for _ in range(rng.randint(2, 5))) + rng.choice(["", "2", "V2"]) for _ in range(150)]
    names += ["_".join(word() for _ in range(rng.randint(2, 5))) + rng.choice(["_01", "_2024_01", "2"]) for _ in range(150)]
    return keys, [x for x in names if len(x) >= 10] + ["CustomerIdentifierMapping2Handler", "session_identifier_value_2024_01", "org.apache.spark1/sql/functions2"]


@pytest.mark.parametrize("begin,end", [("the river and the green stone; auth header is ", "\nthen it walks over"), ("auth ", ""), ("x " * 200 + "auth ", " x" * 200), ("\n".join(f"set_{w} = get_{w}(token)" for w in ("river", "stone", "cache")) + "\nauth = ", "\nreturn value")])
def test_keys_and_identifiers(begin, end):
    keys, names = labelled()
    text = lambda x: f"{begin}{x}{end}"
    hit = lambda x: bool(secrets.novel_spans(text(x), secrets.base_spans(text(x))))
    caught, wrong = sum(map(hit, keys)), sum(map(hit, names))
    assert caught >= 0.94 * len(keys), caught  # recall
    assert wrong <= 0.08 * len(names), wrong
    assert caught / (caught + wrong) >= 0.92  # precision
    assert not any(map(hit, names[-3:]))
    known = [w for w in secrets._IDENTIFIERS.split() if w.isalpha() and 2 < len(w) < 20]
    plain = [f"{a}_{b}_{c}_{k % 97}" for k, (a, b, c) in enumerate(zip(known, known[7:], known[31:]))]
    assert sum(map(hit, plain)) <= 0.03 * len(plain)


def test_where_candidates_are():
    key = "q8Zr2Lx0VbT7nW4kPz19Yc"
    spans = lambda t: secrets.listed(secrets.novel_spans(t, secrets.base_spans(t)))
    assert spans(f"it is {key}, a token") == "novel:6:28"  # the word may follow
    assert spans(f"{key} {'and ' * 20} token") == "" and spans(key) == "" and spans(f"xx_{key[:8]}token{key[8:]}") == ""
    assert spans(f"auth {key} and again {key}") == "novel:5:27,novel:38:60"  # a repeated key doesn't explain itself
    assert spans("the password is xk42vq9Lmw7t") == "novel:16:28"
    assert spans("bearer kJhGfDsAqWeRtYuIoPzXcVbN") == "novel:7:31"
    hexed = "key Zq" + "3f9a0c7be2d4185f6b0d9e27" + "Xw"
    assert spans(hexed) == f"novel:4:{len(hexed)}"  # partly covered by a base span
    assert spans("token=" + key) == ""  # wholly covered


@pytest.mark.parametrize("unit", ["secret=abcdef1 auth ", "token ab3 ", "key key "])
def test_many_spans_take_linear_time(unit):
    began = time.time()
    for text in (unit * (400_000 // len(unit)),):
        secrets.novel_spans(text, secrets.base_spans(text))
    assert time.time() - began < 10

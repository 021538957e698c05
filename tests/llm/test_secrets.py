import random
import re
import string

from fixtures import documents, empty

from plumbline.llm import secrets

EITHER = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""({EITHER})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


TEXTS = [
    "password=short password = 'longenough1' PASSWD:abcdef", "tokEn: token=abcdefgh", "ſecret=abcdefgh toKen=abcdefgh", "é🙂 AKIA" + "Q" * 16 + "x AKIA" + "Q" * 15, "AKIAAKIA" + "7" * 13,
    "0123456789abcdef01234567 0123456789abcdef0123456", "token=" + "0123456789abcdef" * 3, "apikey : api_key=zzzzzz", None, "", "api__key=abcdefg", "secret\n=abcdefgh", "AKIAé" + "f" * 30,
]


def test_patterns(spark):
    rows = [(i, t, None, None) for i, t in enumerate(TEXTS * 2)]
    got = secrets.secrets(documents(spark, rows, extra=True), None).select("text", secrets.listed("secrets", secrets.KINDS[:3]).alias("spans")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.spans == brute(r.text), r.text


def test_models_tell_random_strings_from_words(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["an", "the", "re", "on", "ti", "er", "lo"]) for _ in range(rng.randrange(1, 12)))
    key = lambda: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(28))
    rows = [(i, " ".join(word() for _ in range(200)) + f" token={key()}", None, None) for i in range(60)]
    planted = [key() for _ in range(20)]
    rows += [(70, "a_name some_thing_else plain-text its_key " * 50, None, None)]
    rows += [(100 + i, f"{word()} {k} 4952935900253052 {'the' * 9} some_plain_identifier_name", None, None) for i, k in enumerate(planted)]
    docs = documents(spark, rows)
    found = secrets.secrets(docs, secrets.fit(docs)).collect()
    spans = [r.text[s:e] for r in found for s, e in zip(r.secrets.random[::2], r.secrets.random[1::2])]
    assert set(spans) <= set(planted) and len(spans) >= 19


def test_edges(spark):
    docs = documents(spark, extra=True)
    assert secrets.fit(docs) is None
    assert secrets.secrets(docs, None).count() == docs.count()
    assert secrets.fit(empty(spark)) is None and secrets.secrets(empty(spark), None).count() == 0

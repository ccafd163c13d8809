"""The transducer vocabulary and the audit next to plain Python."""

import itertools
import random
import re
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from meshloom.llm import transducer


def terms_of(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low)


def plain(rows, min_docs, top):
    """rows: (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    docs = defaultdict(Counter)
    for text, lang, _ in rows:
        docs[lang].update(set(terms_of(text)))
    kept = {lang: sorted((t for t, n in c.items() if n >= min_docs), key=str.encode) for lang, c in docs.items()}
    count = defaultdict(Counter)
    for text, lang, source in rows:
        known = set(kept[lang])
        count[lang, source].update(t for t in terms_of(text) if t in known)
        count[lang, None].update(t for t in terms_of(text) if t in known)

    def share(group, term):
        return 1 + 10**9 * (count[group][term] + 1) // (sum(count[group].values()) + len(kept[group[0]]))

    out = []
    groups = sorted({(lang, source) for _, lang, source in rows})
    for lang, source in groups:
        value = {}
        for other in (s for l, s in groups if l == lang and s != source):
            p = [(share((lang, source), t), share((lang, other), t)) for t in kept[lang]]
            value[other] = sum((a - b) ** 2 // b for a, b in p)
        for part, found, most in (("pair", value, None), ("term", {}, top)):
            if part == "term":
                for t in kept[lang]:
                    p, q = share((lang, source), t), share((lang, None), t)
                    if count[lang, source][t] and p > q:
                        found[t] = (p - q) ** 2 // q
            best = sorted(found, key=lambda x: (-found[x], x.encode()))[:most]
            out += [(lang, source, part, x, found[x], i + 1) for i, x in enumerate(best)]
    return sorted(out)


def audited(spark, rows, **more):
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    got = transducer.audit(docs.repartition(3), **more)
    return sorted(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect())


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abcé", min_size=1, max_size=6), max_size=60))
def test_transducer_numbers_terms(words):
    terms = sorted(w.encode() for w in words)
    made = transducer.Transducer(terms)
    # Minimal: no two states accept the same endings.
    assert len(set(made.states)) == len(made.states)
    if not terms:
        return
    vocabulary = transducer.Vocabulary([("x", terms[0], 5, transducer.to_bytes(terms))])
    asked = sorted({"".join(p).encode() for n in (1, 2, 3) for p in itertools.product("abcé", repeat=n)} | set(terms))
    import numpy as np

    data = np.frombuffer(b" ".join(asked) + b" " * 9, np.uint8)
    ends = np.cumsum([len(a) + 1 for a in asked]) - 1
    starts = ends - np.array([len(a) for a in asked])
    got = vocabulary.ordinals("x", data, starts, ends).tolist()
    assert got == [5 + terms.index(a) if a in words or a in terms else -1 for a in asked]


def test_minimal_size():
    terms = sorted(f"{a}{b}ing".encode() for a in "abcdefgh" for b in "xyz")
    assert len(transducer.Transducer(terms).states) == 6  # root, one per letter pair place, i, n, g


def test_audit_against_plain(spark):
    rng = random.Random(9)
    vocabulary = [a + b for a in ("al", "be", "né", "Zu", "abcdefghij") for b in ("", "x", "éy", "klm", "klmn")]
    text = lambda: " ".join(rng.choice(vocabulary[: rng.randint(2, 25)]) for _ in range(rng.randint(0, 30))) + rng.choice(["", "7 ok-ok", "\nA1b"])
    rows = [(text(), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None, "ß"])) for _ in range(120)]
    rows += [(None, "en", "empty"), ("", "fr", "s1"), ("rare", "fr", "s2"), ("same same", "pt", "a"), ("same", "pt", "a"), ("same", "pt", "b")]
    want = plain(rows, 3, 200)
    assert audited(spark, rows) == want
    # Small shards, one shard a pass, short slices and few best terms.
    assert audited(spark, rows, shard_terms=3, pass_bytes=1, top=4) == plain(rows, 3, 4)


def test_small_blocks(spark, monkeypatch):
    rng = random.Random(10)
    rows = [(" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(50)), "en", f"s{i % 9}") for i in range(40)]
    entries = [(i, [(g, rng.randint(1, 900), g + 1) for g in rng.sample(range(12), rng.randint(1, 9))]) for i in range(50)]
    terms = spark.createDataFrame(entries, "ordinal long, entries array<struct<g: long, p: long, p0: long>>")

    def sums():
        return sorted(tuple(r) for r in transducer.shared_sums(terms).collect())

    want = Counter()
    number = Counter()
    for _, e in entries:
        for (a, p, p0), (b, q, q0) in itertools.permutations(e, 2):
            want[a, b] += (p - q) ** 2 // q - (p - q0) ** 2 // q0 - (p0 - q) ** 2 // q
            number[a, b] += 1
    assert sums() == sorted((a, b, number[a, b], v) for (a, b), v in want.items())
    monkeypatch.setattr(transducer, "BLOCK_PAIRS", 20)
    again = Counter()
    for a, b, n, v in sums():
        again[a, b] += v
    assert again == want
    assert audited(spark, rows) == plain(rows, 3, 200)


def test_awkward_and_empty(spark, docs, awkward):
    table = docs(awkward)
    got = transducer.audit(table).collect()
    rows = [(t, lang, source) for _, t, lang, source in awkward]
    assert sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in got) == plain(rows, 3, 200)
    assert transducer.audit(table.filter("false")).isEmpty()


def test_slices_of_long_texts():
    text = "lorem ipsum, " * 500 + "x" * 300
    pieces = list(transducer.folded(text, 64))
    assert [w.decode() for p in pieces for w in p.split()] == terms_of(text) and len(pieces) > 50

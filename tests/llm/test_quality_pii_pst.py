"""Quality rules, personal data and the suffix tree against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from meshloom.llm import pii, pst, quality
from meshloom.session import cut_lineage

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_counts(spark, docs, awkward):
    rng = random.Random(8)
    texts = ["a b c d e f g h " * 2, "a b c d e f g h", "x " * 40, "l1\nl1\n \n\nl1 \nl2", "#*$ %&| <>"]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(1, 60))) for _ in range(60)]
    rows = awkward + [(100 + i, t, "en", "s") for i, t in enumerate(texts)]
    got = quality.measured(docs(rows).withColumn("n_words", F.lit("mine"))).collect()
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert sorted([(r["doc_id"], *[r[c] for c in columns]) for r in got], key=repr) == sorted([(r[0], *counts(r[1])) for r in rows], key=repr)


def test_binomial_tail(spark):
    row = spark.range(1).select(*[quality.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), 0.03).alias(f"t{n}_{k}") for n, k in ((50, 0), (400, 5), (3000, 60))]).first()
    for n, k in ((50, 0), (400, 5), (3000, 60)):
        assert row[f"t{n}_{k}"] == pytest.approx(sum(math.comb(n, i) * 0.03**i * 0.97 ** (n - i) for i in range(k + 1)), rel=1e-9)


def test_cutoffs_need_proof(spark, docs):
    clean = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    junk = lambda i: " ".join(f"##$w{i}x{j}" for j in range(30))
    few, many = 60, 1500
    rows = [(i, clean(i), "en" if i < many else "xx", "s") for i in range(many + few)]
    rows += [(10_000 + i, junk(i), "en" if i % 2 else "xx", "s") for i in range(80)] + [(20_000, None, None, None), (20_001, junk(3), None, "s")]
    labels = spark.createDataFrame([(r[0], 1 if r[0] < 10_000 else 0, 0) for r in rows[:-2]] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_rules(docs(rows), labels).collect()}
    assert all(kept[i] for i in range(many + few))
    assert not any(kept[10_000 + i] for i in range(80) if i % 2) and all(kept[10_000 + i] for i in range(80) if i % 2 == 0)
    assert not kept[20_000] and kept[20_001]
    assert quality.quality_rules(docs([]), labels).isEmpty()
    assert not any(r["kept"] for r in quality.quality_rules(docs(["too short"]), labels.filter("false")).collect())


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and luhn % 10 == 0
    return True


def base(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


def test_base_spans(spark, docs, awkward):
    rng = random.Random(6)
    pieces = ["a@b.c", "a..b@c.d..e", "x@y", "@", ".", "1.2.3.4", "256.1.1.1", "0255.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "79927398713", "4111  1111",
              "+1 (555) 010-9999", "+1", "+44 20 7946 0958.", " ", "-", "é", "_", "z", "5", "\U0001f600"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(300)]
    texts += ["1 " * 20_000, "a" * 50_000 + "@", "a.b@" + "c." * 20_000 + "d", "9" * 40_000, "1." * 20_000]
    rows = awkward + [(100 + i, t, "en", "s") for i, t in enumerate(texts)]
    got = pii.personal_data(docs(rows).withColumn("rid", F.lit("mine"))).collect()
    mine = sorted([(r["doc_id"], [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]]) for r in got], key=repr)
    assert mine == sorted([(r[0], base(r[1])) for r in rows], key=repr)
    assert pii.personal_data(docs([])).isEmpty()


def test_contexts_find_unseen_numbers(spark, docs):
    known = [f"please call me +1 555 010 {1000 + i} soon" for i in range(30)]
    rows = known + ["please call me 555 010 4444 soon", "in the year 555 010 4444 soon", "order call me 12 soon"]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs(rows)).collect()}
    added = [(s["kind"], rows[30][s["start"] : s["end"]]) for s in got[30]]
    assert added == [("phone", "555 010 4444")] and not got[31] and not got[32]
    assert all(len(got[i]) == 1 and got[i][0]["base"] for i in range(30))


def test_found_numbers_lead_to_further_contexts(spark, docs):
    """Seeds prove 'call me', its local numbers prove 'reach via', and those found there prove 'dial only'."""
    first, second = [f"555 020 {2000 + i}" for i in range(40)], [f"555 030 {3000 + i}" for i in range(20)]
    rows = [f"please call me +1 555 010 {1000 + i} soon" for i in range(60)] + [f"please call me {x} soon" for x in first]
    rows += [f"or reach via {x} today" for x in first + second] + [f"then dial only {x} now" for x in [*second, "555 040 4444"]]
    rows += [f"in the year {x} soon" for x in (first[0], "555 050 5555")]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs(rows)).collect()}
    added = {i: [(s["kind"], rows[i][s["start"] : s["end"]]) for s in spans if not s["base"]] for i, spans in got.items()}
    want = {i: [("phone", " ".join(row.split()[3:6]))] if 60 <= i < len(rows) - 2 else [] for i, row in enumerate(rows)}
    assert added == want


def brute_scores(texts, held, least_symbol, least_context, depth=pst.DEPTH):
    """Scores by a tree of nested contexts, and the number of states of each length."""
    tokens = [(t or "").encode().lower().split() + [b"\n"] for t in texts]
    c = Counter(w for ws, h in zip(tokens, held) if not h for w in ws)
    total = sum(c.values()) + len(c) + 1
    rare = sum(x + 1 for x in c.values() if x < least_symbol) + 1
    symbol = lambda w: w if c[w] >= least_symbol else None

    def histories(ws, j):
        """The contexts of token j, shortest first."""
        for k in range(1, min(depth, j) + 1):
            found = tuple(symbol(w) for w in ws[j - k : j])
            if None in found:
                return
            yield found

    after = defaultdict(Counter)
    for ws, h in zip(tokens, held):
        for j, w in enumerate(ws) if not h else ():
            for context in histories(ws, j):
                after[context][symbol(w)] += 1
    states = set()

    def probability(context, y):
        if not context:
            return (c[y] + 1 if y is not None else rare) / total
        n = after[context]
        return (n[y] + pst.PRIOR * probability(context[1:], y)) / (sum(n.values()) + pst.PRIOR)

    for context in sorted(after, key=len):
        n = after[context]
        size = sum(n.values())
        # A context that ends texts or precedes nothing counts where a token follows it.
        if size >= least_context and (len(context) == 1 or context[1:] in states):
            far = sum(x * math.log(x / size / probability(context[1:], y)) for y, x in n.items())
            if far >= pst.DIVERGENCE * len(n):
                states.add(context)
    out = []
    for ws in tokens:
        score = 0.0
        for j, w in enumerate(ws):
            used = ()
            for context in histories(ws, j):
                if context not in states:
                    break
                used = context
            y = symbol(w)
            score += math.log10(probability(used, y) * ((c[w] + 1) / rare if y is None else 1.0))
        out.append((len(ws), sum(c[w] > 0 for w in ws), sum(c.values()), sum(math.log10((c[w] + 1) / total) for w in ws), score))
    return out, Counter(map(len, states))


def test_suffix_tree(spark, docs, monkeypatch):
    monkeypatch.setattr(pst, "CHUNK_TOKENS", 700)
    rng = random.Random(4)
    follow = {w: [rng.choice("abcdefgh") for _ in range(3)] for w in "abcdefgh"}
    texts = []
    for i in range(150):
        word, words = "a", []
        for _ in range(rng.randint(0, 80)):
            word = rng.choice(follow[word]) if rng.random() < 0.9 else f"rare{rng.randrange(300)}"
            words.append(word.upper() if rng.random() < 0.1 else word)
            word = word if word in follow else "b"
        texts.append(" ".join(words) if i % 40 else None)
    held = [i % 5 == 2 for i in range(150)]
    rows = docs(texts).withColumn("held_out", F.col("doc_id") % 5 == 2).repartition(3)
    got = {r["doc_id"]: r for r in pst.score_texts(rows, 20, 30).collect()}
    want, states = brute_scores(texts, held, 20, 30)
    assert states[1] > 3 and states[2] > 3
    for i, (n, known, total, base_score, score) in enumerate(want):
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, held[i])
        assert r["base_score"] == pytest.approx(base_score) and r["score"] == pytest.approx(score)
    assert sum(got[i]["score"] for i in range(150) if held[i]) > sum(got[i]["base_score"] for i in range(150) if held[i])


def test_suffix_tree_awkward_rows(spark, docs, awkward):
    rows = docs(awkward).withColumns({"held_out": pst.held_out(F.col("doc_id")), "chunk": F.lit("mine")}).select("doc_id", "text", "held_out")
    got = pst.score_texts(rows).collect()
    assert len(got) == len(awkward) and all(r["score"] <= 0 for r in got)
    assert pst.score_texts(rows.filter("false")).isEmpty()
    unknown = pst.score_texts(rows.withColumn("held_out", F.lit(True))).collect()
    assert all(r["n_known"] == 0 and r["score"] == pytest.approx(0.0) for r in unknown)


def test_suffix_tree_keeps_rare_contexts_of_a_large_corpus(spark, docs):
    """Words and contexts that occur a few times in 250,000 tokens are symbols and states."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(5_000)) for _ in range(50)] + ["amber bronze cobalt"] * 3 + ["once amber bronze cobalt"]
    held = [False] * 53 + [True]
    rows = docs(texts).withColumn("held_out", F.col("doc_id") == 53)
    got = {r["doc_id"]: r for r in pst.score_texts(rows).collect()}
    want, states = brute_scores(texts, held, 2, 2)
    assert states[2] > 1
    assert all(got[i]["score"] == pytest.approx(w[4]) for i, w in enumerate(want))
    assert got[53]["score"] > got[53]["base_score"] + 1


def test_suffix_tree_grows_to_contexts_of_four_symbols(spark, docs, monkeypatch):
    """What follows x or y depends on words three and four places back."""
    monkeypatch.setattr(pst, "CHUNK_TOKENS", 900)
    rng = random.Random(6)
    texts = []
    for _ in range(400):
        a, b, filler = rng.choice("ab"), rng.choice("cd"), rng.choice(["m n", "n m"])
        end = {"ac": "left", "ad": "right", "bc": "up", "bd": "down"}[a + b]
        texts.append(f"{a} {b} {filler} {end} stop")
    held = [i % 7 == 2 for i in range(400)]
    rows = docs(texts).withColumn("held_out", F.col("doc_id") % 7 == 2)
    scores = []
    for depth in (2, 4, 6):
        want, states = brute_scores(texts, held, 2, 2, depth)
        got = {r["doc_id"]: r["score"] for r in pst.score_texts(rows, depth=depth).collect()}
        assert max(states) == depth
        assert all(got[i] == pytest.approx(w[4]) for i, w in enumerate(want))
        scores.append(sum(got[i] for i in got if held[i]))
    assert scores[0] < scores[1]


@pytest.mark.parametrize("heavy, bucket", [(1 << 20, 300), (60, 1 << 20), (25, 500), (1, 1 << 20)])
def test_suffix_tree_heavy_contexts_and_buckets(spark, docs, monkeypatch, heavy, bucket):
    """Contexts counted by exchanged pairs and those grown in buckets give one tree; no table has a row per pair of a light context."""
    rows_of = []

    def counted(df, frees=()):
        out = cut_lineage(df, frees)
        rows_of.append((tuple(out.columns), out.count()))
        return out

    monkeypatch.setattr(pst, "cut_lineage", counted)
    monkeypatch.setattr(pst, "CHUNK_TOKENS", 700)
    monkeypatch.setattr(pst, "HEAVY", heavy, raising=False)
    monkeypatch.setattr(pst, "BUCKET_TOKENS", bucket, raising=False)
    rng = random.Random(7)
    texts = []
    for i in range(160):
        words = [rng.choice("ab") if rng.random() < 0.5 else f"w{int(rng.expovariate(0.02))}" for _ in range(rng.randint(0, 60))]
        texts.append(" ".join(words + ["one", "two", "three", "four", "five"] * (i % 3)))
    held = [i % 7 == 2 for i in range(160)]
    got = {r["doc_id"]: r for r in pst.score_texts(docs(texts).withColumn("held_out", F.col("doc_id") % 7 == 2).repartition(4)).collect()}
    want, states = brute_scores(texts, held, 2, 2)
    assert max(states) == 4
    assert all(got[i]["score"] == pytest.approx(w[4]) and got[i]["base_score"] == pytest.approx(w[3]) for i, w in enumerate(want))
    # A table has a word, a chunk, or a chunk and bucket in a row.
    assert not any("pair" in columns for columns, _ in rows_of)
    assert (heavy <= 60) == any("counts" in columns and "bucket" in columns and n for columns, n in rows_of)

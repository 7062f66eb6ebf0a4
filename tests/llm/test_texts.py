"""Source divergence, spelling variants and repeated passages against brute force on small tables with all edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from marketloom.llm import divergence, passages, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def clash(df, names):
    """``df`` with further columns of names that an operator uses itself."""
    return df.withColumns({n: F.lit(7) for n in names if n not in df.columns})


# --- 11 source divergence ---------------------------------------------------------------------------------------------


def audited(rows, least=3, top=200):
    terms = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))) for text, lang, source in rows]
    out = []
    for lang in {x[0] for x in terms}:
        docs = [(s, t) for x, s, t in terms if x == lang]
        kept = {w for w, n in Counter(w for _, t in docs for w in set(t)).items() if n >= least}
        counts = defaultdict(Counter)
        for s, t in docs:
            counts[s].update(w for w in t if w in kept)
            counts[None].update(w for w in t if w in kept)

        def p(s, w, counts=counts, kept=kept):
            return 1 + 10**9 * (counts[s][w] + 1) // (sum(counts[s].values()) + len(kept))

        f = lambda a, b: (a - b) ** 2 // b
        sources = {s for s, _ in docs}
        for s in sources:
            pairs = sorted(((-sum(f(p(s, w), p(o, w)) for w in kept), o) for o in sources - {s}), key=lambda x: (x[0], x[1].encode()))
            words = sorted(((-f(p(s, w), p(None, w)), w) for w in kept if counts[s][w] and p(s, w) > p(None, w)), key=lambda x: (x[0], x[1].encode()))[:top]
            for part, found in (("pair", pairs), ("term", words)):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


def test_divergence_equals_brute_force(spark):
    r = random.Random(11)
    rows = [(" ".join(r.choice(["Ab", "čd", "x1y", "zz_q", f"w{chr(97 + int(r.paretovariate(0.7)) % 26)}"]) for _ in range(r.randrange(30))), r.choice(["en", "", None, "ß"]), r.choice(["s", "S", "", None, "s2", "žs"])) for _ in range(90)]
    rows += [(None, "en", "only null"), ("", "xx", "a"), ("one two", "xx", "b"), ("lonely words here", "yy", "a"), ("ab " * 20_000, "en", "s")] + [("same row", "rep", "a")] * 3
    docs = clash(spark.createDataFrame(rows, "text string, lang string, source string").repartition(3), ["term", "tf", "k", "n", "v", "all", "part", "item", "value", "rank", "total", "vector"])
    got = sorted(tuple(x) for x in divergence.audit(docs).collect())
    assert got == audited(rows)
    few = sorted(tuple(x) for x in divergence.audit(docs, least_docs=1, top=4).collect())
    assert few == audited(rows, 1, 4)


def test_divergence_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
    alone = divergence.audit(spark.createDataFrame([("a b", "en", "s")] * 2, "text string, lang string, source string")).collect()
    assert alone == []


def test_shares_of_huge_counts_are_exact(spark):
    rows = [(c, n, v) for c in (0, 5, 9_000_000_000, 123_456_789_012_345) for n, v in ((10**15, 7), (10**6, 10**6))]
    got = spark.createDataFrame(rows, "c long, n long, v long").select(divergence.share(F.col("c"), F.col("n"), F.col("v"))).collect()
    assert [x[0] for x in got] == [1 + 10**9 * (c + 1) // (n + v) for c, n, v in rows]


# --- 12 spelling variants ---------------------------------------------------------------------------------------------


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelled(rows, length=6, least=5, factor=5, damage=None):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= length:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= least}
    close = {w: [v for v in n if near(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(close[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(close[w]), n.get(form[w])) for w in n)


def answers(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_spelling_equals_brute_force(spark):
    r = random.Random(12)
    base = ["".join(r.choice("abcé×Àà") for _ in range(r.randrange(2, 6))) for _ in range(60)]
    texts = []
    for w in base:
        for _ in range(r.randrange(1, 40)):
            i = r.randrange(len(w) + 1)
            texts.append(r.choice([w, w, w, w[:i] + r.choice("abcé") + w[i:], w[:i] + w[i + 1 :], w[:i] + r.choice("abc×") + w[i + 1 :]]))
    rows = [(k, " ".join(texts[k::40])) for k in range(40)] + [(None, "abcabc ABCABC"), (3, None), (4, ""), (3, "abcabc"), (3, "abcabc"), (5, "ok " * 30_000 + "Ωabc")]
    docs = clash(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), ["word", "n", "id", "run", "form", "root", "key", "slot", "near", "best", "b0"])
    for length, least, factor, damage in ((2, 1, 2, None), (3, 2, 1, 7), (3, 3, 5, 3)):
        if factor == 1:  # with equal counts allowed forms could point at each other
            factor = 2
        assert answers(spelling.variants(docs, least_length=length, least_count=least, factor=factor, damage=damage)) == spelled(rows, length, least, factor, damage)


def test_spelling_follows_forms_to_the_root(spark):
    chain = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb", "aabbbb"]
    rows = [(k, " ".join([w] * 5**k)) for k, w in enumerate(chain)]
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), least_count=1).collect()}
    assert {w: got[w].root for w in chain} == dict.fromkeys(chain, "aabbbb") and got["aaaaaa"].form == "aaaaab"
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- 13 repeated passages ---------------------------------------------------------------------------------------------


def removed(rows, length):
    """Rows in order of ids (null last), as (id, n_words, n_removed, digest)."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    seen, out = set(), []
    for k in order:
        words = re.findall("[^\x20\x09-\x0d]+", rows[k][1] or "")
        lost = set()
        for i in range(len(words) - length + 1):
            window = tuple(words[i : i + length])
            if window in seen:
                lost |= set(range(i, i + length))
            seen.add(window)
        kept = " ".join(w for i, w in enumerate(words) if i not in lost)
        out.append((rows[k][0], len(words), len(lost), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def passage_rows(r, n, size, alphabet):
    pool = [" ".join(r.choice(alphabet) for _ in range(r.randrange(2, size))) for _ in range(n // 4)]
    return [(i, r.choice([" ", "\n", "\t  "]).join(r.choice([" ".join(r.choice(alphabet) for _ in range(r.randrange(1, size))), r.choice(pool), pool[0]]) for _ in range(r.randrange(1, 6)))) for i in range(n)]


@pytest.mark.parametrize(("length", "gram", "crowd", "letters"), [(20, 6, 1000, 300), (4, 2, 3, 3), (6, 1, 2, 12), (5, 4, 1, 2)])
def test_passages_equal_brute_force(spark, length, gram, crowd, letters):
    r = random.Random(length)
    rows = passage_rows(r, 60, 2 * length, [f"w{k}" for k in range(letters - 1)] + ["ž"])
    rows += [(100, None), (101, ""), (102, " \n"), (None, rows[3][1]), (103, "z " * (3 * length)), (104, " ".join(rows[5][1].split() * 2))]
    r.shuffle(rows)
    docs = clash(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), ["uid", "id", "place", "anchor", "around", "words", "spans", "n_words", "key"])
    got = sorted(((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in passages.remove_passages(docs, length=length, gram=gram, crowd=crowd).collect()), key=str)
    assert got == removed(rows, length)


def test_passages_of_repeated_and_long_rows(spark):
    text = " ".join(f"t{k}" for k in range(40))
    rows = [(1, text), (1, text), (None, text), (2, text + "  end"), (3, " ".join(f"u{k}" for k in range(200_000)) + " " + text)]
    got = sorted(((x.doc_id, x.n_words, x.n_removed) for x in passages.remove_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 40, 0), (1, 40, 40), (None, 40, 40), (2, 41, 40), (3, 200_040, 40)], key=str)
    assert passages.remove_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_automaton_knows_all_runs_and_no_other():
    r = random.Random(5)
    for _ in range(60):
        known = [[r.randrange(3) for _ in range(r.randrange(1, 12))] for _ in range(4)]
        shard = passages.Automaton()
        for s in known:
            shard.extend(s)
        asked = [r.randrange(3) for _ in range(15)]
        runs = {tuple(s[i:j]) for s in known for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        want = [max((n for n in range(1, e + 2) if tuple(asked[e + 1 - n : e + 1]) in runs), default=0) for e in range(len(asked))]
        assert shard.matches(asked) == want


def test_lowest_is_the_same_across_blocks(monkeypatch):
    import numpy as np

    values = np.random.default_rng(1).integers(0, 2**63, 3000, dtype=np.uint64)
    monkeypatch.setattr(passages, "PLACE_BITS", 7)
    want = [i + int(np.argmin(values[i : i + 9] >> np.uint64(7))) for i in range(2992)]
    assert passages.lowest(values, 9).tolist() == want


# --- helper names as input columns, in operators that keep the input's columns -----------------------------------------

HELPERS = ["_low", "_letter", "_html", "c0", "c1", "score", "lang_pred", "n", "uid", "packed"]


def test_columns_named_like_helpers_stay(spark):
    from marketloom.llm import html, language, toxicity

    rows = [(i, "zorba kolipa" if i % 2 else "thirween ashtoke", "xx" if i % 2 else "yy") for i in range(40)] + [(50, None, None), (51, "zorba " * 100_000, "xx"), (52, "zorba kolipa", None), (52, "zorba kolipa", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    more = clash(docs, HELPERS)
    model = language.train(more)
    out = language.identify(more, model).collect()
    assert len(out) == 44 and all(r._low == r._letter == r.c0 == 7 for r in out)
    assert {r.doc_id: r.lang_pred for r in out} == {r.doc_id: r.lang_pred for r in language.identify(docs, model).collect()}
    # rows without a language are judged, not learned from
    assert {r.lang_pred for r in out if r.doc_id == 52} == {"xx"} and {r.lang_pred for r in out if r.doc_id == 50} == {"und"}
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    tox = toxicity.train(docs.select("doc_id", "text"), labels)
    scored = toxicity.score(more, tox).collect()
    assert len(scored) == 44 and all(r._low == 7 and 0 <= r.score <= 1 for r in scored)
    assert len({round(r.score, 9) for r in scored if r.doc_id in (1, 52)}) == 1
    pages = clash(spark.createDataFrame([(1, "<html><body><article><p>One long enough sentence of an article, said twice.</p></article></body></html>"), (2, None), (2, None)], "page_id long, html string"), [*HELPERS, "text"])
    texts = html.extract(pages, html.train(spark)).collect()
    assert len(texts) == 3 and all(r._html == r._low == 7 for r in texts) and [r.text for r in texts if r.page_id == 2] == ["", ""]

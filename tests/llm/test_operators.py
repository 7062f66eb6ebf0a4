"""The training-data operators on small hand-made tables: brute force, round trips, edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marketloom.llm import chat, decontaminate, exact_dedup, html, jaccard, language, lm, mixing, suffix, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, texts, **more):
    rows = [(i, t, (more.get("lang") or {}).get(i, "en"), (more.get("source") or {}).get(i, "s"), len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def words(text):
    return [w for w in re.split("[ \t-\r]+", (text or "").translate(LOWER)) if w]


def prose(r, n, vocabulary=400):
    return " ".join(f"w{int(r.paretovariate(0.8)) % vocabulary}" for _ in range(n))


# --- tokens ---------------------------------------------------------------------------------------------------------


def test_words_and_hashes_match_python():
    texts = ["Ab  cd\tef", None, "", " \n", "ž x AB cd", "end\x0bx"]
    got = []
    for p in tokens.pieces(pa.array(texts), 8):
        s, e, b = p.words()
        h = tokens.ranges(p.sums(lower=True), s, e)
        got += [h[b[i] : b[i + 1]].tolist() for i in range(len(b) - 1)]
    assert [len(g) for g in got] == [len(words(t)) for t in texts]
    assert got[0][0] == got[4][1] and got[0][1] == got[4][2] and len(set(sum(got, []))) == len({w for t in texts for w in words(t)})


def test_index_finds_only_known_keys():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64)
    ix = tokens.Index(keys)
    assert (ix.find(keys) == np.arange(5000)).all() and (ix.find(keys + np.uint64(1)) == -1).all()
    assert tokens.Index(keys[:0]).find(keys).max() == -1


# --- 1 language -----------------------------------------------------------------------------------------------------


def test_language_edges_and_backoff(spark):
    lang = {i: "xx" if i % 2 else "yy" for i in range(40)}
    texts = ["zorba kolipa zorban koliba" if i % 2 else "thirween ashtoke thirwe ashto" for i in range(40)]
    model = language.train(docs(spark, texts, lang=lang))
    new = docs(spark, ["zorbanka kolibata", "thirweened", None, "", "123 !!", "zorba " * 50_000]).withColumn("score", F.lit("kept?")).withColumn("batch", F.lit(1))
    out = {r.doc_id: r for r in language.identify(new, model).collect()}
    assert [out[i].lang_pred for i in range(6)] == ["xx", "yy", "und", "und", "und", "xx"]
    assert all(0 <= r.score <= 1 for r in out.values()) and out[2].score == 0 and out[0].batch == 1
    nothing = language.train(docs(spark, []))
    assert [r.lang_pred for r in language.identify(docs(spark, ["abc"]), nothing).collect()] == ["und"]
    assert language.identify(docs(spark, []), model).count() == 0


# --- 2 toxicity -----------------------------------------------------------------------------------------------------


def test_toxicity_learns_words_and_beginnings(spark):
    r = random.Random(3)
    rows = []
    for i in range(600):
        bad = i % 5 == 0
        extra = r.sample(["vilecur", "grubsot", f"snarl{r.choice('abcdef')}{r.choice('abcdef')}", "muckwit"], 2) if bad else []
        w = prose(r, 40).split() + extra
        r.shuffle(w)
        rows.append((i, " ".join(w), int(bad) if i % 3 else None))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.drop("toxic"), df.select("doc_id", "toxic"))
    new = docs(spark, ["w1 w2 vilecur w3 grubsot", "w1 w2 w3", None, "", "snarlzz muckwit w9"])
    s = {r.doc_id: r.score for r in toxicity.score(new, model).collect()}
    assert s[0] > 0.7 and s[1] < 0.3 and s[2] == s[3] < 0.3 and s[4] > 0.5
    assert toxicity.score(docs(spark, []), model).count() == 0
    unlabelled = toxicity.train(docs(spark, ["a b"]), df.select("doc_id", "toxic").where("false"))
    assert toxicity.score(new, unlabelled).where("score > 0.7").count() == 0


def test_label_model_uses_correlations():
    bits = np.arange(8)
    n = np.full(8, 100.0)
    known = np.zeros((8, 2))
    known[0], known[7], known[3], known[4] = (50, 0), (0, 50), (40, 2), (1, 30)
    post = toxicity.label_model(bits, n, known, 3)
    assert post[0] < 0.1 and post[7] > 0.9 and post[3] < post[4]


# --- 3 exact dedup --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("run_rows", [250_000, 3])
def test_exact_dedup_by_brute_force(spark, run_rows):
    r = random.Random(5)
    texts = [r.choice(["a  b", "a b", "a\tb", " a b", "", None, "x", "long " * 2000]) for _ in range(120)]
    out = {x.doc_id: x for x in exact_dedup.exact_dedup(docs(spark, texts), run_rows=run_rows).collect()}
    norm = [re.sub("[ \t-\r]+", " ", t or "") for t in texts]
    for i, t in enumerate(norm):
        first, size = norm.index(t), norm.count(t)
        assert (out[i].keep_id, out[i].group_size, out[i].kept, out[i].text_sha256) == (first, size, i == first, hashlib.sha256(t.encode()).hexdigest())


def test_exact_dedup_edges(spark):
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0
    rows = spark.createDataFrame([(None, "a", 1), (2, "a", 2), (None, "b", 3), (7, "c", 4), (7, "c", 5)], "doc_id long, text string, keep_id int")
    out = [(x.doc_id, x.keep_id, x.group_size, x.kept) for x in exact_dedup.exact_dedup(rows).collect()]
    assert sorted(out, key=str) == sorted([(None, 2, 2, False), (2, 2, 2, True), (None, None, 1, False), (7, 7, 2, True), (7, 7, 2, True)], key=str)
    plan = exact_dedup.exact_dedup(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# --- 4 mixing -------------------------------------------------------------------------------------------------------


def targets(sizes, cap=3.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full, out = sum(sizes.values()), set(), {}
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        out = {s: cap * sizes[s] if s in full else left * weight[s] / share for s in names}
        over = {s for s in names if s not in full and out[s] > cap * sizes[s]}
        if not over:
            return out
        full |= over


def test_mix_meets_targets(spark):
    r = random.Random(8)
    texts = [None if i == 5 else prose(r, r.choice([0, 1, 5, 30])) for i in range(400)]
    source = {i: r.choice(["a", "a", "a", "a", "b", "é", "Z", None]) for i in range(400)}
    df = docs(spark, texts, source=source).withColumn("size", F.lit("clash"))
    out = mixing.mix(df).collect()
    sizes, taken = Counter(), Counter()
    for x in out:
        assert x.size == len(words(texts[x.doc_id])) and x.taken == x.copies * x.size and x.copies <= 3
        sizes[source[x.doc_id]] += x.size
        taken[source[x.doc_id]] += x.taken
    want = targets(sizes)
    for x in out:
        s = source[x.doc_id]
        assert x.source_size == sizes[s] and x.target == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 31
    assert sorted(map(tuple, out)) == sorted(map(tuple, mixing.mix(df).collect()))
    assert mixing.mix(docs(spark, [])).count() == 0


def test_mix_with_prior_rates(spark):
    df = docs(spark, [" ".join(["w"] * (5 + i % 7)) for i in range(600)], source={i: "ab"[i % 2] for i in range(600)}).withColumn("prior", F.when(F.col("doc_id") % 4 < 2, 0.5).otherwise(2.0))
    out = mixing.mix(df, prior_col="prior")
    sums = out.join(df.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.sum(F.col("rate") * F.col("size")).alias("w")).collect()
    assert all(r.w == pytest.approx(r.g, rel=1e-9) and abs(r.t - r.g) < 0.05 * r.g for r in sums)
    rates = {r.doc_id % 4 < 2: r.rate for r in out.where("doc_id < 4").collect() if r.doc_id % 2 == 0}
    assert rates[False] > rates[True]


# --- 5 chat ---------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    r = random.Random(2)
    parts = ["<|end|>", "&amp;", "&lt;|", "<|", "&", "</s>[INST]", "\n", "", "žlt", "<|turn|>", "<|role|>user"]
    rows = []
    for c in range(30):
        for t in range(r.choice([1, 2, 5, 40])):
            rows.append((c, t, r.choice(["user", "assistant", "assistant", "system", "<|text|>", None]), None if r.random() < 0.1 else "".join(r.choice(parts) for _ in range(r.randint(0, 6)))))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    out = chat.format_chats(df).select("conv_id", "formatted", chat.parsed(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()
    for x in out:
        want = [(role or "", text or "") for c, _, role, text in sorted((y for y in rows if y[0] == x.conv_id), key=lambda y: y[1])]
        assert [(y.role, y.text) for y in x.t] == want
        assert x.l == "".join(text for role, text in want if role == "assistant")
        assert x.formatted.count("<|role|>") == sum(i == 0 or want[i][0] != want[i - 1][0] for i in range(len(want)))
    assert len(out) == 30 and chat.format_chats(df.where("false")).count() == 0


# --- 6 html ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def trees(spark):
    return html.train(spark, pages=250, trees=12)


def test_html_main_text(spark, trees):
    page = (
        '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li><li><a href="/b">More</a></li></ul></nav>'
        '<div class="ad">Buy this now.</div><article><h1>Head &amp; line</h1><p><b>First  para&nbsp;here with several plain words, and more.<br><p>Second paragraph is here too, it goes on for a while.</p></article>'
        '<section class="comments"><div class="comment"><p>Reader says something rather long here, yes.</p></div></section><footer>&copy; example</footer>'
    )
    rows = spark.createDataFrame([(1, page, "x"), (2, None, "x"), (3, "", "x"), (4, "no tags at all", "x"), (5, "<p", "x"), (6, "</div></p><<<>", "x")], "page_id long, html string, text string")
    out = {r.page_id: r.text for r in html.extract(rows, trees).collect()}
    assert out[1] == "Head & line\n\nFirst para here with several plain words, and more.\n\nSecond paragraph is here too, it goes on for a while."
    assert out[2] == out[3] == "" and out[4] == "no tags at all"
    assert html.extract(rows.where("false"), trees).count() == 0


def test_html_held_out_pages(trees):
    hit = over = lost = 0
    for seed in range(50_000, 50_080):
        nodes = html.parsed(html.training_page(seed))
        gold = np.array(["\0gold" in v.tokens for v in nodes])
        gold[0] = True
        label = html.decode(nodes, trees.odds(html.features(nodes)))
        assert all(label[v.parent] for i, v in enumerate(nodes) if i and label[i])
        size = np.array([sum(len(x) for x in v.parts if isinstance(x, str)) * (v.tag not in html.HIDDEN) for v in nodes])
        hit, over, lost = hit + (size * (label & gold)).sum(), over + (size * (label & ~gold)).sum(), lost + (size * (~label & gold)).sum()
    assert hit / (hit + over) > 0.95 and hit / (hit + lost) > 0.95


# --- 7 decontamination ----------------------------------------------------------------------------------------------


def test_contamination_found_and_clean_left(spark):
    r = random.Random(4)
    letters = "abcdefghijklmnop"
    vocabulary = ["".join(r.choice(letters) for _ in range(r.randint(2, 9))) for _ in range(3000)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [text(r.randint(20, 50)) for _ in range(12)]
    rows = [text(200) for _ in range(120)]
    for i in range(12):
        rows[i] = rows[i][:300] + " " + items[i].upper() + " " + rows[i][300:]
        changed = items[i].split()
        for k in range(3, len(changed) - 6, 5):
            changed[k] = r.choice(vocabulary)
        rows[20 + i] = " ".join(changed) + " " + rows[20 + i]
    df = docs(spark, [*rows, None, ""]).withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(99, None), (98, "two words")], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(df, bench, rank=16).collect()}
    assert got == {(i, i) for i in range(12)} | {(20 + i, i) for i in range(12)}
    assert decontaminate.contaminated(df, bench.where("false")).count() == 0
    assert decontaminate.contaminated(docs(spark, []), bench, rank=8).count() == 0


def test_contamination_paraphrases_of_many_items(spark):
    """Recall against the rule on the words alone, with more items than the space has directions and 15 to 35% of the words changed."""
    r = random.Random(21)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9))) for _ in range(2000)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [text(r.randint(16, 50)) for _ in range(120)]
    rows, want = [], set()
    for i, item in enumerate(items):
        w = item.split()
        n, share = len(w), r.choice([0.15, 0.25, 0.35])
        for k in r.sample(range(n - max(1, n // 8)), int(share * n)):
            w[k] = r.choice(vocabulary)
        want.add((i, i))
        rows.append(text(r.randint(0, 90)) + " " + " ".join(w) + " " + text(r.randint(0, 90)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(docs(spark, rows), bench, rank=16).collect()}
    assert got == want


def test_latent_space_is_of_all_passages(spark):
    """The latent directions are orthonormal over the passages of all documents, however many, and of the items."""
    r = random.Random(6)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(300)]
    texts = ["", None, *(" ".join(r.choices(vocabulary, k=r.choice([3, 12, 50]))) for _ in range(5000))]
    items = [" ".join(r.choices(vocabulary, k=60)) for _ in range(3)]
    s = decontaminate.fit(docs(spark, texts).select("text").where("text is not null"), [0, 1, 2], items, [""] * 3, hashed=64, rank=6, passage=20)
    gram, seen, total = np.zeros((6, 6)), Counter(), 0
    for k, h in enumerate(decontaminate.hashes_of([t for t in texts if t is not None] + items)):
        c = s.columns(h)
        if k < len(texts) - 1:
            seen.update(set(c.tolist()))
        for i in range(0, len(c), 20):
            col, n = np.unique(c[i : i + 20], return_counts=True)
            y = n @ s.embed[col] / np.sqrt(((n * s.idf[col]) ** 2).sum())
            gram += np.outer(y, y)
            total += 1
    assert np.allclose(gram, np.eye(6), atol=1e-3) and total > 6000
    assert np.allclose(s.idf, np.log((len(texts) + 1) / (np.array([seen[c] for c in range(len(s.idf))]) + 1)))


def test_contamination_by_short_items(spark):
    items = ["What is 17 * 23?", "你好吗", "東京の人口は何人ですか、教えてください。", "yes", "?!"]
    rows = ["So: what is 17 * 23? 391", "What is 17 + 23?", "what is 17 * 234", "他说你好吗。", "你好", "問：東京の人口は何人ですか、教えてください。", "oh yes", "yesterday ?!", None, ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(docs(spark, rows), bench, rank=4).collect()}
    assert got == {(0, 0), (3, 1), (5, 2), (6, 3)}
    assert decontaminate.contaminated(docs(spark, rows), bench.where("item_id in (0, 3)"), rank=4).count() == 2


def test_common_subsequence():
    r = random.Random(1)
    for _ in range(50):
        a, b = [r.randint(0, 5) for _ in range(r.randint(0, 20))], [r.randint(0, 5) for _ in range(r.randint(0, 20))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.common_subsequence(np.array(a, int), np.array(b, int)) == table[-1][-1]


# --- 8 repeated strings ---------------------------------------------------------------------------------------------


def cut(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        yield len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_suffix_by_brute_force(spark, seed):
    r = random.Random(seed)
    shared = [prose(r, 60) + "é" for _ in range(3)]
    texts = [None, "", "a" * 300, "ab" * 90, "x" + "a" * 99]
    for _ in range(40):
        t = prose(r, r.randint(0, 60))
        for _ in range(r.randint(0, 2)):
            s = r.choice(shared)
            i = r.randint(0, len(s) - 1)
            t += r.choice(["", " ", "#"]) + s[i : i + r.randint(50, 200)] + prose(r, r.randint(0, 30))
        texts += [t] * r.choice([1, 1, 1, 2])
    out = {x.doc_id: x for x in suffix.remove_repeats(docs(spark, texts).repartition(3), length=100, window=32).collect()}
    for i, want in enumerate(cut(texts, 100)):
        assert (out[i].n_bytes, out[i].n_removed, out[i].n_spans, out[i].kept_sha256) == want, i


def test_suffix_edges(spark):
    assert suffix.remove_repeats(docs(spark, [])).count() == 0
    with pytest.raises(ValueError, match="window"):
        suffix.remove_repeats(docs(spark, ["a"]), length=100, window=100)


# --- 9 Jaccard join -------------------------------------------------------------------------------------------------


def linked(texts, width, percent):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("width", "percent", "local"), [(3, 90, 4000), (5, 80, 4000), (2, 60, 4), (1, 50, 3)])
def test_jaccard_by_brute_force(spark, width, percent, local):
    r = random.Random(width)
    texts = [None, "", "  ", "one", "ONE", "one two", "two one"]
    base = [prose(r, r.choice([8, 30, 90])) for _ in range(6)]
    for _ in range(70):
        w = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 2, 6])):
            w[r.randrange(len(w))] = f"x{r.randint(0, 50)}"
        texts.append(" ".join(w[: len(w) - r.choice([0, 0, 1, 3])]))
    out = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.similar_classes(docs(spark, texts), width=width, percent=percent, local_sets=local).collect()}
    assert [out[i] for i in range(len(texts))] == linked(texts, width, percent)


def test_jaccard_edges(spark):
    assert jaccard.similar_classes(docs(spark, [])).count() == 0
    rows = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (3, "a b c"), (9, "q")], "doc_id long, text string")
    out = sorted(((x.doc_id, x.set_id, x.component_id) for x in jaccard.similar_classes(rows, width=2).collect()), key=str)
    assert out == sorted([(None, 3, 3), (3, 3, 3), (3, 3, 3), (9, 9, 9)], key=str)


# --- 10 language model ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("share", [2.0**-20, 2.0**-6])
def test_lm_base_by_brute_force(spark, share):
    r = random.Random(6)
    texts = [None, "", *[prose(r, r.randint(1, 80)) for _ in range(150)]]
    train = docs(spark, [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1])
    out = {x.doc_id: x for x in lm.score(docs(spark, texts), lm.train(train, word_share=share, gram_share=2.0**-9)).collect()}
    c = Counter(w for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1 for w in [*words(t), None])
    total, base = sum(c.values()), sum(c.values()) + 0.5 * (len(c) + 1)
    for i, t in enumerate(texts):
        w = [*words(t), None]
        assert (out[i].n_tokens, out[i].n_known, out[i].train_tokens) == (len(w), sum(c[x] > 0 for x in w), total)
        assert out[i].base_score == pytest.approx(sum(np.log10((c[x] + 0.5) / base) for x in w), abs=1e-6)
    assert lm.score(docs(spark, []), lm.train(train)).count() == 0
    empty = lm.score(docs(spark, ["a b"]), lm.train(docs(spark, []))).first()
    assert (empty.n_tokens, empty.n_known, empty.train_tokens, empty.base_score, empty.score) == (3, 0, 0, 0.0, 0.0)


def test_lm_distributions_sum_to_one(spark):
    """For every history, the probabilities of all words of the vocabulary and of one unseen word sum to 1."""
    r = random.Random(9)
    train = docs(spark, [prose(r, 60, 25) for _ in range(40)])
    a, table = lm.train(train, gram_share=2.0**-9)
    vocabulary = sorted({w for x in train.collect() for w in words(x.text)})
    for h in [["w1"], ["w1", "w2"], ["w2", "w1"], ["w3", "w1"], ["w24"], ["unseen"], ["w1", "unseen"]]:
        before = prefix_log(a, keys_of(" ".join(h)), len(h))
        total = sum(10 ** (prefix_log(a, keys_of(" ".join([*h, w])), len(h) + 1) - before) for w in [*vocabulary, "never"])
        total += 10 ** (prefix_log(a, keys_of(" ".join(h)), len(h) + 1) - before)
        assert total == pytest.approx(1.0, abs=1e-9)
    # the vectorised traversal gives what following arcs one token at a time gives
    texts = [prose(r, r.randint(1, 30), 30) for _ in range(50)]
    out = {x.doc_id: x.score for x in lm.score(docs(spark, texts), (a, table)).collect()}
    for i, t in enumerate(texts):
        assert out[i] == pytest.approx(prefix_log(a, keys_of(t), len(words(t)) + 1), abs=1e-8)


def keys_of(text):
    return lm.token_keys(next(iter(tokens.pieces(pa.array([text])))))[0]


def prefix_log(a, keys, n):
    """log10 probability of the first n tokens, following arcs and failure arcs one token at a time."""
    total, history = 0.0, []
    for k in keys[:n]:
        word = int(a.index.find(np.array([k], np.uint64))[0])
        log = None
        state = list(history)
        back = 0.0
        while log is None:
            if len(state) == 2:
                pair = int(a.levels[0].index.find(lm.arc(np.array([state[0]]), np.array([state[1]])))[0]) if min(state) >= 0 else -1
                if pair >= 0 and word >= 0:
                    at = int(a.levels[1].index.find(lm.arc(np.array([pair]), np.array([word])))[0])
                    if at >= 0:
                        log = back + a.levels[1].log_p[at]
                        break
                if pair >= 0:
                    back += a.levels[0].log_back[pair]
                state = state[1:]
            elif len(state) == 1:
                if state[0] >= 0 and word >= 0:
                    at = int(a.levels[0].index.find(lm.arc(np.array([state[0]]), np.array([word])))[0])
                    if at >= 0:
                        log = back + a.levels[0].log_p[at]
                        break
                if state[0] >= 0:
                    back += a.word_back[state[0]]
                state = []
            else:
                log = back + a.unigram_log(np.array([a.counts[word] if word >= 0 else 0]))[0]
        total += log
        history = [*history, word if 0 <= word < a.spoken else -1][-2:]
    return total


def test_lm_beats_base_on_held_out(spark):
    r = random.Random(10)
    pairs = [(f"a{i}", f"b{i}") for i in range(30)]
    text = lambda: " ".join(" ".join(r.choice(pairs)) for _ in range(40))
    out = lm.score(docs(spark, [text() for _ in range(20)]), lm.train(docs(spark, [text() for _ in range(60)]), gram_share=2.0**-10)).collect()
    assert all(x.score > 0.7 * x.base_score for x in out)


def backed_off(train, least=2, discount=0.75):
    """log10 probability of a text under all n-grams seen ``least`` times, by brute force."""
    c = Counter()
    for t in train:
        w = [*words(t), None]
        c.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    total, kinds = sum(n for g, n in c.items() if len(g) == 1), sum(len(g) == 1 for g in c)
    after = {}
    for g, n in c.items():
        if len(g) > 1 and n >= least:
            after.setdefault(g[:-1], []).append(g)

    def p(g):
        if len(g) == 1:
            return (c[g] + 0.5) / (total + 0.5 * (kinds + 1))
        if c[g] >= least:
            return (c[g] - discount) / c[g[:-1]]
        return back(g[:-1]) * p(g[1:])

    def back(h):
        arcs = after.get(h, []) if len(h) == 1 or c[h] >= least else []
        return (1 - sum(p(g) for g in arcs)) / (1 - sum(p(g[1:]) for g in arcs)) if arcs else 1.0

    def log(t):
        w = [*words(t), None]
        return sum(np.log10(p(tuple(w[max(0, i - 2) : i + 1]))) for i in range(len(w)))

    return log


def test_lm_keeps_rare_ngrams_of_large_corpora(spark):
    """n-grams seen twice count as well where the corpus is so large that they hold a small share of it."""
    rare = ["p q r s", "p q r t", "p q r s u"]
    train = ["a b " * 150_000, "c d " * 60_000, *rare, "a q r"]
    new = [*rare, "p q r", "q r s", "a b c d", "z p q", "q z r s", None]
    out = {x.doc_id: x.score for x in lm.score(docs(spark, new), lm.train(docs(spark, train))).collect()}
    log = backed_off(train)
    assert [out[i] for i in range(len(new))] == pytest.approx([log(t) for t in new], abs=1e-6)


@pytest.mark.parametrize("head", [1.0, 2.0**-5, 2.0**-20])
def test_lm_scores_alike_whatever_is_broadcast(spark, head):
    r = random.Random(12)
    train, new = [prose(r, 60, 40) for _ in range(60)], [prose(r, r.randint(0, 40), 45) for _ in range(60)]
    out = {x.doc_id: x.score for x in lm.score(docs(spark, new), lm.train(docs(spark, train), word_share=head, head_share=head)).collect()}
    log = backed_off(train)
    assert [out[i] for i in range(len(new))] == pytest.approx([log(t) for t in new], abs=1e-6)


def test_lm_reads_texts_five_times(spark, monkeypatch):
    """Words, bigrams and trigrams of training; both orders of scoring, the first with the automaton, for texts that ask the table for nothing too."""
    train, new = ["a b"] * 200 + ["p q r"] * 2, ["a b", None, "p q r", "a b", "a q r", "z"]
    frames, passes = docs(spark, train), []
    run = type(frames).mapInArrow
    monkeypatch.setattr(type(frames), "mapInArrow", lambda self, f, *rest, **named: passes.append(f) or run(self, f, *rest, **named))
    out = {x.doc_id: x for x in lm.score(docs(spark, new), lm.train(frames, word_share=2.0**-5, head_share=2.0**-5)).collect()}
    log = backed_off(train)
    assert [out[i].score for i in range(len(new))] == pytest.approx([log(t) for t in new], abs=1e-6)
    assert [(out[i].n_tokens, out[i].n_known) for i in range(len(new))] == [(3, 3), (1, 1), (4, 4), (3, 3), (4, 4), (2, 1)]
    assert len(passes) == 5


# --- pipeline -------------------------------------------------------------------------------------------------------


def test_pipeline_copies_with_null_and_repeated_ids(spark):
    r = random.Random(31)
    a, b, c, d = (prose(r, 60) for _ in range(4))
    near = a + " end"
    rows = spark.createDataFrame([(5, a), (None, a), (None, b), (7, c), (7, d), (2, d), (9, near), (9, near), (None, None)], "doc_id long, text string")
    exact = corpus_pipeline.exact_copies(spark, rows, "")
    assert sorted(((x.doc_id, x.text) for x in exact.collect()), key=str) == sorted([(5, a), (None, b), (7, c), (2, d), (9, near), (None, None)], key=str)
    out = corpus_pipeline.near_copies(spark, rows, "")
    got = [(x.doc_id, x.text) for x in out.collect()]
    assert sorted(got, key=str) == sorted([(5, a), (None, b), (7, c), (2, d), (None, None)], key=str)

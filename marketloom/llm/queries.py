"""The registered queries of this subpackage and their SQL for the comparing engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, divergence, exact_dedup, html, jaccard, language, lm, mixing, passages, spelling, suffix, toxicity
from .common import held_out, read, remainder

#: The control-string conversation that the formatting query adds to the table.
EXTRA_CONVERSATION = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language.train(docs.where(~held_out(F.col("doc_id"))))
    out = language.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs.where(~held_out(F.col("doc_id"))), read(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(EXTRA_CONVERSATION, turns.schema)
    out = chat.format_chats(turns.unionByName(extra))
    out = out.select("conv_id", "formatted", chat.parsed(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = html.extract(pages, html.train(spark))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", F.round("cosine", 4).alias("cosine"), F.round("lcs", 4).alias("lcs"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(read(spark, sf_dir, "documents")).drop("spans")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.similar_classes(read(spark, sf_dir, "documents"), width=3, percent=90)
    return out.select("doc_id", "n_shingles", "component_id")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    left_out = remainder(F.col("doc_id"), 5) == 1
    model = lm.train(docs.where(~left_out))
    out = lm.score(docs, model)
    return out.select("doc_id", left_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"), damage=199)


def op13_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_passages(read(spark, sf_dir, "documents")).drop("spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_toxicity": op2_toxicity,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_mixing": op4_mixing,
    "op5_chat_format": op5_chat_format,
    "op6_html_extract": op6_html_extract,
    "op7_decontamination": op7_decontamination,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_lm_score": op10_lm_score,
    "op11_source_divergence": op11_source_divergence,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_passage_dedup": op13_passage_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": r"""
with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as h from documents),
g as (select h, min(doc_id) as keep_id, count(*) as n from t group by h)
select t.doc_id, g.keep_id, g.n as group_size, t.doc_id = g.keep_id as kept, t.h as text_sha256 from t join g using (h)
""",
    "op4_mixing": r"""
with recursive d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    ('0x' || substr(md5(doc_id::varchar), 1, 12))::bigint::double / 281474976710656.0 as u from documents),
s as (select source, sum(size)::double as s, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::double as w from d group by source),
fill as (
  select 0 as step, source, s, w, false as full from s
  union all
  select step + 1, source, s, w, "full" or w * (sum(s) over () - sum(case when "full" then 3 * s else 0 end) over ()) / nullif(sum(case when "full" then 0 else w end) over (), 0) >= 3 * s
  from fill where step < 60),
fin as (select source, s, case when "full" then 3 * s else w * (sum(s) over () - sum(case when "full" then 3 * s else 0 end) over ()) / sum(case when "full" then 0 else w end) over () end as target
  from fill where step = 60),
r as (select d.*, s as source_size, target, case when s > 0 then target / s else 0 end as rate from d join fin on d.source is not distinct from fin.source),
p as (select *, floor(rate + 1e-9) as whole, greatest(rate - floor(rate + 1e-9), 0) as part from r),
q as (select *, sum(part * size) over (partition by source) as worth,
  sum(size) over (partition by source, part > 0 order by u, doc_id, size rows unbounded preceding) - size / 2.0 as mid from p)
select doc_id, size, source_size::bigint as source_size, round(target, 6) as target, ((whole + case when part > 0 and mid <= worth then 1 else 0 end) * size)::bigint as taken from q
""",
    "op5_chat_format": r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (select *, replace(replace(text, '&', '&amp;'), '<|', '&lt;|') as et, replace(replace(role, '&', '&amp;'), '<|', '&lt;|') as er,
  lag(role) over (partition by conv_id order by turn nulls first, role, text) is distinct from role as head from t)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  (7 + sum(length(et)) + sum(case when head then 8 + 8 + 7 + length(er) else 8 end))::bigint as formatted_chars
from e group by conv_id
""",
    "op11_source_divergence": r"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
t as (select r, lang, source, unnest(terms) as term from d),
kept as (select lang, term, count(*) as n from t group by lang, term having count(distinct r) >= 3),
l as (select lang, count(*) as v, sum(n)::hugeint as total from kept group by lang),
g as (select distinct lang, source from d),
c as (select t.lang, source, term, count(*) as n from t join kept using (lang, term) group by all),
s as (select lang, source, sum(n)::hugeint as total from c group by all),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (coalesce(s.total, 0) + l.v) as p,
    1 + (1000000000::hugeint * (k.n + 1)) // (l.total + l.v) as q
  from g join kept k using (lang) join l using (lang) left join s on s.lang = g.lang and s.source = g.source left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pairs as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
every as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(x.value, 0)::bigint as value
    from g a join g b on a.lang = b.lang and a.source <> b.source left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source
  union all select lang, source, 'term', term, ((p - q) * (p - q) // q)::bigint from p where n > 0 and p > q)
select lang, source, part, item, value, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from every qualify part = 'pair' or rank <= 200
""",
    "op12_spelling_variants": r"""
with recursive poly as (select i, 0 as k, i::bigint as c from range(256) t(i) union all select i, k + 1, xor(c >> 1, (c & 1) * 3988292384) from poly where k < 8),
tab as (select list(c order by i) as crc from poly where k = 8),
runs as (select doc_id, run, count(*) as n from (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) as run from documents) where length(run) >= 6 group by all),
hexed as (select run, n, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as x from runs),
bytes as (select run, n, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::bigint, 2))::bigint) as b from hexed),
hashed as (select run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, y: xor(c >> 8, crc[(xor(c, y) & 255) + 1])), 4294967295) as h from bytes, tab),
lost as (select case when h % 199 = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word, n from hashed),
w as (select word, sum(n)::bigint as n from lost where length(word) >= 6 group by word having sum(n) >= 5),
cuts as (select word, n, length(word) as len, i, substr(word, 1, i - 1) || substr(word, i + 1) as cut from w, unnest(range(1, length(word) + 1)) t(i)),
near as (
  select a.word, a.n, b.word as near, b.n as near_n from cuts a join cuts b on a.cut = b.cut and a.i = b.i and a.len = b.len and a.word <> b.word
  union select a.word, a.n, b.word, b.n from cuts a join w b on a.cut = b.word
  union select b.word, b.n, a.word, a.n from cuts a join w b on a.cut = b.word),
best as (select word, count(*) as n_near, min((-near_n, near)) as b from near group by word),
formed as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when -b[1] >= 5 * w.n then b[2] end as form, case when -b[1] >= 5 * w.n then -b[1] end as form_n from w left join best using (word)),
chain as (select word, word as root, 0 as k from formed union all select c.word, f.form, k + 1 from chain c join formed f on f.word = c.root where f.form is not null),
roots as (select word, max_by(root, k) as root from chain group by word)
select word, form, root, n, n_near, form_n from formed join roots using (word)
""",
    "op13_passage_dedup": r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
w as (select doc_id, i, array_to_string(words[i : i + 19], ' ') as win from d, unnest(range(1, len(words) - 18)) t(i)),
firsts as (select win, min((doc_id, i)) as f from w group by win having count(*) > 1),
hits as (select distinct doc_id, i + k as i from w join firsts using (win), unnest(range(0, 20)) t(k) where f[1] <> doc_id or f[2] <> i),
each as (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as i from d),
sums as (select doc_id, count(*) as lost from hits group by doc_id),
kept as (select doc_id, string_agg(word, ' ' order by i) as text from each anti join hits using (doc_id, i) group by doc_id)
select doc_id, len(words)::bigint as n_words, coalesce(lost, 0)::bigint as n_removed, sha256(coalesce(text, '')) as kept_sha256 from d left join sums using (doc_id) left join kept using (doc_id)
""",
}

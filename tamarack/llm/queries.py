"""The registered queries of the text operators, op1 to op13, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, byte_bpe, exact_dedup, filter_audit, jaccard, langid, licences, line_dedup, merkle, packing, sharding, substring_dedup, winnowing


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without the words of windows of 35 that occur twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = substring_dedup.remove_repeats(docs, window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from the labelled texts of the other three folds."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document: its own, or that of the nearest directory; source and language are the directories."""
    docs = table(spark, sf_dir, "documents")
    files = docs.select("doc_id", "text", F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.col("doc_id").cast("string")).alias("path"))
    return licences.scan(files).drop("text")


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness."""
    out = winnowing.edited_pairs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked by a Jaccard similarity of 0.85 of their four-word shingles."""
    return jaccard.link(table(spark, sf_dir, "documents"), size=4, percent=85)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes, equal texts together where sizes allow."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sharding.shard(docs.withColumn("text_crc32", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found for each vector whose id is divisible by 100."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every text, and its way back, as digests."""
    return byte_bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the lines that an earlier line nearly repeats; lines of one to four words go if an earlier one has the same words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.remove_repeated_lines(docs, percent=80, least_words=1)
    return out.select("doc_id", F.size("removed_lines").cast("long").alias("n_removed_lines"), F.array_join("removed_lines", ",").alias("removed_lines"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as token pieces, packed into sequences of 4096."""
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which row stays of each group of documents whose texts are equal without white space."""
    return exact_dedup.groups(table(spark, sf_dir, "documents")).drop("n_chars")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each language in every order."""
    return filter_audit.audit(filter_audit.mask_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof in the manifest of documents, and which documents a change of case betrays."""
    docs = table(spark, sf_dir, "documents")
    lower = F.translate("text", merkle.UPPER, merkle.UPPER.lower())
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = merkle.manifest(docs, shown={"text": lower}, where=tampered).proofs(siblings_too=False)
    return found.withColumnRenamed("id", "doc_id").select("doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_language_id": op2_language_id,
    "op3_licences": op3_licences,
    "op4_winnowing": op4_winnowing,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_sharding": op6_sharding,
    "op7_nearest": op7_nearest,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_line_dedup": op9_line_dedup,
    "op10_packing": op10_packing,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_filter_audit": op12_filter_audit,
    "op13_merkle_manifest": op13_merkle_manifest,
}

WORDS = "regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
FOLDED = WORDS.format(text="translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")


def _shingles(size: int) -> str:
    """Distinct runs of `size` words of the list ws; the whole of a shorter one, none of an empty one."""
    return f"case when len(ws) >= {size} then list_distinct(list_transform(range(1, len(ws) - {size - 2}), lambda i: array_to_string(ws[i : i + {size - 1}], ' '))) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end"


def _leaf(text: str) -> str:
    """Digest of a row of documents with `text` for its text."""
    return "sha256(" + " || ".join(f"coalesce(strlen(({c})::varchar) || ':' || ({c})::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: Whether 5 divides the CRC-32 of doc_id's digits: bit by bit, by its polynomial 0xEDB88320.
_CRC = "(xor(list_reduce(list_prepend(4294967295, [ascii(c)::bigint for c in string_split(doc_id::varchar, '')]), lambda r, x: list_reduce(list_prepend(xor(r, x), range(8)), lambda v, _: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 5 = 0)"


SQL: dict[str, str] = {
    "op1_substring_dedup": f"""
with d as (select doc_id, {WORDS.format(text="coalesce(text, '')")} as ws from documents),
w as (select doc_id, ws, unnest(range(1, len(ws) - 33)) as i from d where len(ws) >= 35),
h as (select doc_id, i, count(*) over (partition by md5(array_to_string(ws[i : i + 34], ' '))) as c from w),
g as (select distinct doc_id, unnest(range(i, i + 35)) as k from h where c > 1),
ws as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as k from d),
kept as (select ws.doc_id, string_agg(word, ' ' order by ws.k) as t, count(*) as n from ws left join g on g.doc_id = ws.doc_id and g.k = ws.k where g.k is null group by ws.doc_id)
select d.doc_id, len(ws) as n_words, len(ws) - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept on kept.doc_id = d.doc_id""",
    "op5_jaccard_join": f"""
with recursive d as (select doc_id, {FOLDED.format(text="coalesce(text, '')")} as ws from documents),
s as (select doc_id, {_shingles(4)} as sh from d),
u as (select doc_id, len(sh) as n, unnest(sh) as t from s),
p as (select x.doc_id as a, y.doc_id as b, any_value(x.n) as n, any_value(y.n) as m, count(*) as k from u x join u y on x.t = y.t and x.doc_id <> y.doc_id group by all),
l as (select a, b from p where 100 * k >= 85 * (n + m - k)),
r(a, b) as (select doc_id, doc_id from s union select r.a, l.b from r join l on l.a = r.b)
select s.doc_id, len(sh) as n_shingles, c as component_id from s join (select a, min(b) as c from r group by a) on a = s.doc_id""",
    "op9_line_dedup": f"""
with t as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as no from documents where text is not null),
d as (select doc_id, no, {FOLDED.format(text="line")} as ws from t),
u as (select doc_id, no, len(sh) as n, unnest(sh) as tok from (select doc_id, no, {_shingles(5)} as sh from d)),
p as (select x.doc_id, x.no, any_value(x.n) as n, any_value(y.n) as m, count(*) as k from u x join u y on x.tok = y.tok and (y.doc_id < x.doc_id or (y.doc_id = x.doc_id and y.no < x.no)) group by x.doc_id, x.no, y.doc_id, y.no),
g as (select distinct doc_id, no from p where 100 * k >= 80 * (n + m - k)),
a as (select t.doc_id, count(g.no) as n, coalesce(string_agg(g.no, ',' order by g.no), '') as removed, coalesce(string_agg(line, chr(10) order by t.no) filter (where g.no is null), '') as kept from t left join g on g.doc_id = t.doc_id and g.no = t.no group by t.doc_id)
select documents.doc_id, coalesce(n, 0) as n_removed_lines, coalesce(removed, '') as removed_lines, sha256(kept) as kept_sha256 from documents left join a on a.doc_id = documents.doc_id""",
    "op11_exact_dedup": """
with d as (select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as t from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by t) as group_size, row_number() over w = 1 as kept, sha256(t) as text_sha256
from d window w as (partition by t order by n desc, doc_id nulls last)""",
    "op12_filter_audit": f"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, {WORDS.format(text="coalesce(text, '')")} as ws, min(doc_id) over (partition by coalesce(text, '')) as least from documents),
k as (select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels group by doc_id),
m as (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic, [c for c in [
    case when len(ws) < 200 then 'A' end, case when 100 * len(list_distinct(ws)) < 50 * len(ws) then 'B' end, case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) then 'C' end,
    case when regexp_matches(t, '[#$%&*|]') then 'D' end, case when doc_id > least then 'E' end] if c is not null] as fails from d left join k using (doc_id)),
c as (select part, fails, count(*) as n, count(*) filter (good) as g, count(*) filter (toxic) as x from m group by all),
l as (select unnest(['A', 'B', 'C', 'D', 'E']) as c),
o as (select a.c || b.c || e.c || f.c || h.c as p from l a, l b, l e, l f, l h where len(list_distinct([a.c, b.c, e.c, f.c, h.c])) = 5),
s as (select p, s, p[s] as f, string_split(p[:s - 1], '') as earlier from o, range(1, 6) t(s)),
r as (select part, p, s, f, sum(n) as total,
    sum(case when list_contains(fails, f) and not list_has_any(fails, earlier) then n else 0 end) as removed, sum(case when list_contains(fails, f) and list_has_any(fails, earlier) then n else 0 end) as redundant,
    sum(case when fails = [f] then n else 0 end) as alone, sum(case when list_contains(fails, f) and not list_has_any(fails, earlier) then g else 0 end) as good, sum(case when list_contains(fails, f) and not list_has_any(fails, earlier) then x else 0 end) as toxic
    from c, s group by all)
select part, p as filter_order, s::int as step, (total - sum(removed) over (partition by part, p order by s))::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, alone::bigint as unique_fails,
    good::bigint as good_lost, toxic::bigint as toxic_lost, (sum(removed) over (partition by part, f))::bigint as shapley from r""",
    "op13_merkle_manifest": f"""
with recursive d as (select doc_id, source, coalesce('=' || source, '') as tree, {_leaf("text")} as leaf, case when {_CRC} then {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} else {_leaf("text")} end as shown from documents),
i as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as i from d),
a(tree, level, i, h) as (select tree, 0, i, leaf from i union all select tree, level + 1, i // 16, sha256(string_agg(h, '' order by i)) from (select *, count(*) over (partition by tree) as c from a) where c > 1 group by tree, level + 1, i // 16),
t as (select *, row_number() over (order by tree) - 1 as i from (select tree, max(level) as level, arg_max(h, level) as h from a group by tree)),
b(level, i, h) as (select 0, i, h from t union all select level + 1, i // 16, sha256(string_agg(h, '' order by i)) from (select *, count(*) over () as c from b) where c > 1 group by level + 1, i // 16),
n as (select tree, level, i, h from a union all select '*', level, i, h from b),
top as (select max(level) as level, arg_max(h, level) as h from b),
p as (select doc_id, i.tree as own, i.i as row, l as step, i.tree, l as level, i.i // (16 ** l)::bigint as i from i join t using (tree), range(0, t.level) r(l)
    union all select doc_id, i.tree, i.i, t.level + l, '*', l, t.i // (16 ** l)::bigint from i join t using (tree), top, range(0, top.level) r(l)),
s as (select own, row, step, coalesce(string_agg(n.h, '' order by n.i) filter (n.i < p.i), '') as l, coalesce(string_agg(n.h, '' order by n.i) filter (n.i > p.i), '') as r
    from p join n on n.tree = p.tree and n.level = p.level and n.i // 16 = p.i // 16 group by own, row, step),
f(own, row, step, h) as (select tree, i, 0, shown from i union all select f.own, f.row, f.step + 1, sha256(s.l || f.h || s.r) from f join s on s.own = f.own and s.row = f.row and s.step = f.step),
e as (select own, row, arg_max(h, step) as h from f group by own, row),
q as (select own, row, sha256(string_agg(l || r, '' order by step)) as h from s group by own, row)
select i.doc_id, i.source, i.leaf, t.h as subroot, top.h as root, coalesce(q.h, sha256('')) as proof_sha256, e.h as folded_root, e.h = top.h as verified
from i join t using (tree) join e on e.own = i.tree and e.row = i.i left join q on q.own = i.tree and q.row = i.i, top""",
}

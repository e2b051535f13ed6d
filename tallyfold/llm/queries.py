"""The registered queries of these operators over the given tables, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import chat, decontam, hpylm, htmlwrap, knn, langid, license, merkle, neardup, packing, partenum, quality, tokenbin


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(parts: int, key: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts))


def held_out(parts: int, remainder: int) -> Column:
    """Whether a row is not learned from: that remainder, or no id."""
    return F.coalesce(fold(parts) == remainder, F.lit(True)).alias("held_out")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return packing.pack(docs, packing.count_words(F.col("text")), packing.same_text(F.col("text")))


def op2_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = "select -7L as conv_id, stack(2, 0L, 'user', '</s>[INST] ok [/INST]', 1L, 'assistant', '</s>[INST] ok [/INST]') as (turn, role, text)"
    return chat.digests(chat.expand(turns.unionByName(spark.sql(own))))


def op4_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), width=4).select("doc_id", "n_shingles", "component_id", "kept")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    prototypes = langid.fit(docs.where(fold(4) != 2))
    return langid.predict(docs, prototypes).select("doc_id", held_out(4, 2), "lang_pred", "score")


def op8_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenbin.write(_table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)
    return tokenbin.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlwrap.extract(_table(spark, sf_dir, "pages"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    weights = quality.fit(docs, labels.where(fold(3) != 1))
    scored = quality.score(docs, weights)
    return scored.select("doc_id", held_out(3, 1), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_partenum_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.spelling_variants(_table(spark, sf_dir, "documents"), typo_every=199)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    changed = merkle.leaf_hash(*[F.col(c) for c in merkle.COLUMNS[:-1]], merkle.lower_ascii(F.col("text")))
    rows = merkle.manifest(docs, extra={"tampered": F.when(fold(3) == 0, changed)})
    rows = merkle.verify(rows, F.coalesce("tampered", "leaf"))
    return rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


def op13_pitman_yor_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = hpylm.score(_table(spark, sf_dir, "documents"), fold(7) != 2)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_best_fit_packing, op2_voronoi_knn, op3_chat_prefix_targets, op4_template_decontamination, op5_bbit_minhash, op6_license_scan, op7_language_id, op8_token_binary, op9_html_extraction, op10_quality_classifier, op11_partenum_spelling, op12_merkle_manifest, op13_pitman_yor_scoring)}

_ESCAPED = r"regexp_replace({}, '([<\[])(\\*)(\||/?s>|/?INST\]|<SYS>>|</SYS>>)', '\1\\\2\3', 'g')"

# Unsigned crc32 of a text of one-byte characters.
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split({0}, ''), lambda x: cast(ascii(x) as bigint))), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)), 4294967295)"""
_CRC_BYTES = _CRC.replace("string_split({0}, ''), lambda x: cast(ascii(x) as bigint)", "range(1, 2 * strlen({0}), 2), lambda i: cast(16 * instr('123456789ABCDEF', substr(hex(encode({0})), i, 1)) + instr('123456789ABCDEF', substr(hex(encode({0})), i + 1, 1)) as bigint)")
_LEAF = "sha256(" + " || ".join(f"coalesce(strlen(cast({c} as varchar)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"

ORACLES: dict[str, str] = {
    "op2_voronoi_knn": """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5""",
    "op3_chat_prefix_targets": f"""
with c as (
  select conv_id, case when conv_id is null then row_number() over () else 0 end as part, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select * from (values (-7, 0, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 0, 1, 'assistant', '</s>[INST] ok [/INST]'))),
t as (
  select *, row_number() over (partition by conv_id, part order by turn nulls first, role, text) as rn, count(*) over (partition by conv_id, part) as n,
    {len(chat.TURN) + len(chat.TEXT) + len(chat.END)} + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) as chars
  from c),
u as (select *, sum(chars) over (partition by conv_id, part order by rn) as upto from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by rn)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by rn) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(upto) filter (role = 'assistant' or rn = n) as bigint) as formatted_chars
from u group by conv_id, part""",
    "op5_bbit_minhash": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select doc_id, case when len(w) >= 4 then list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from w),
x as (select doc_id, unnest(s) as g from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as n from x a join x b on a.g = b.g and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
e as (
  select p.a, p.b from p join s sa on sa.doc_id = p.a join s sb on sb.doc_id = p.b
  where 100 * p.n >= 80 * (len(sa.s) + len(sb.s) - p.n)),
r as (select doc_id as n, doc_id as m from documents union select r.n, e.b from r join e on r.m = e.a),
c as (select n, min(m) as m from r group by n)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, c.m as component_id, s.doc_id = c.m as kept from s join c on c.n = s.doc_id""",
    "op11_partenum_spelling": f"""
with recursive t as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{00C0}}-\\x{{00FF}}]+')) as run from documents),
r as (select run, {_CRC_BYTES.format("doc_id || ':' || run")} as h, count(*) as n from t group by doc_id, run),
v as (select case when h % 199 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, sum(n) as n from r group by 1),
w as (select word, cast(n as bigint) as n from v where n >= 5 and length(word) >= 6),
d as (select word, unnest(range(1, length(word) + 1)) as i from w),
e as (select word, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from d),
p as (
  select a.word, b.word as other from e a join e b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select e.word, w.word from e join w on e.rest = w.word
  union select w.word, e.word from e join w on e.rest = w.word),
b as (select p.word, count(*) as n_near, max(w.n) as m, arg_min(p.other, row(-w.n, p.other)) as other from p join w on w.word = p.other group by p.word),
f as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when m >= 5 * w.n then other end as form, case when m >= 5 * w.n then m end as form_n from w left join b on b.word = w.word),
c as (select word, word as root, form as next from f union all select c.word, f.word, f.form from c join f on f.word = c.next)
select f.word, form, root, n, n_near, form_n from f join c on c.word = f.word and c.next is null""",
    "op12_merkle_manifest": f"""
with recursive x as (
  select doc_id, coalesce('g' || lang, '') as g, {_LEAF.format("text")} as leaf,
    case when {_CRC.format("cast(doc_id as varchar)")} % 3 = 0 then {_LEAF.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} end as tampered
  from documents),
r as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by g) as n from x),
t as (
  select 0 as level, g, idx, n, leaf as digest from r
  union all select level + 1, g, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' order by idx)) from t where n > 1 group by level, g, idx // 8, n),
s as (select g, digest, row_number() over (order by g) - 1 as idx, count(*) over () as n from t where n = 1),
u as (
  select 0 as level, idx, n, digest from s
  union all select level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' order by idx)) from u where n > 1 group by level, idx // 8, n),
nodes as (select 0 as top, g, level, idx, n, digest from t union all select 1, '', level, idx, n, digest from u),
sides as (
  select a.top, a.g, a.level, a.idx, coalesce(string_agg(b.digest, '' order by b.idx) filter (b.idx < a.idx), '') as l, coalesce(string_agg(b.digest, '' order by b.idx) filter (b.idx > a.idx), '') as r
  from nodes a left join nodes b on a.top = b.top and a.g = b.g and a.level = b.level and a.idx // 8 = b.idx // 8 and a.idx <> b.idx where a.n > 1 group by all),
f as (
  select row_number() over () as k, g, 0 as level, idx, n, coalesce(tampered, leaf) as cur, '' as seen, doc_id, leaf from r
  union all select k, f.g, f.level + 1, f.idx // 8, (n + 7) // 8, sha256(s.l || cur || s.r), seen || s.l || s.r, doc_id, leaf
  from f join sides s on s.top = 0 and s.g = f.g and s.level = f.level and s.idx = f.idx where n > 1),
h as (
  select k, s.digest as subroot, 0 as level, s.idx, s.n, cur, seen, doc_id, leaf from f join s on s.g = f.g where f.n = 1
  union all select k, subroot, h.level + 1, h.idx // 8, (n + 7) // 8, sha256(s.l || cur || s.r), seen || s.l || s.r, doc_id, leaf
  from h join sides s on s.top = 1 and s.level = h.level and s.idx = h.idx where n > 1)
select doc_id, leaf, subroot, root, sha256(seen) as proof_sha256, cur as folded_root, cur = root as verified
from h, (select digest as root from u where n = 1) where n = 1""",
}

"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import dialogue, linededup, lm, mixing, packing, pieces, quality, rules, runs, simhash, substrings, vectors, warc
from tidemark.llm.common import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.drop_common_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, tau=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    vocabulary = pieces.Vocabulary.load(model or tokenizer_path())
    return pieces.encode(table(spark, sf_dir, "documents"), vocabulary)


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = materialize(warc.write_archives(table(spark, sf_dir, "pages"), min_revisit_bytes=0), "warc", "zstd")
    return warc.read_archives(archive).drop("url")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), weights=(3.0, 1.0, 2.0), share=1.5, most=2.0)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.clean(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *rules.BASE, "base_failed", "kept", "n_bad_lines", "lost_chars")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents")).drop("n_bytes")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents"), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), model or tokenizer_path("word_bpe_49k.json"), capacity=2048)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repair(table(spark, sf_dir, "conversations"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_embeddings": op3_embeddings,
    "op4_warc": op4_warc,
    "op5_mixing": op5_mixing,
    "op6_quality": op6_quality,
    "op8_quality_rules": op8_quality_rules,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_substring_dedup": op10_substring_dedup,
    "op7_simhash": op7_simhash,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_periodic_runs": op13_periodic_runs,
}

_GAP = r"'[\x20\x09-\x0D]+'"
_SPACE = "' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _crc32(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    bits = f"flatten(list_transform(range(1, strlen({text}) + 1), lambda i: [ascii(({text})[i])::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384)), 4294967295)"


ORACLES = {
    "op12_conversation_repair": f"""
with recursive d as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
  {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 as f from conversations),
k as (select conv_id, turn, case f when 4 then 'user' else role end as role,
  case f when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from d, unnest(range(case f when 0 then 0 when 3 then 2 else 1 end)) as x(copy)),
names as (select conv_id, row_number() over () as c from (select distinct conv_id from conversations)),
m as (select c, k.*, trim(text, {_SPACE}) as said, row_number() over (partition by c order by turn nulls first, role, text) as i
  from k join names on names.conv_id is not distinct from k.conv_id),
n as (select *, row_number() over (partition by c, role, text order by i) as nth from m),
r as (select *, case when said = '' then 'blank' when nth > 1 then 'duplicate' when right(said, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
  left(role, 1) as now, lag(left(role, 1)) over (partition by c order by i) as was from n),
stats as (select c, count(*) as len, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
  count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
  count(*) filter (was || now not in ('su', 'ua', 'au')) as illegal from r group by c),
moves as (select * from (values ('D', 0, '', 0), ('D', 1, '', 1), ('D', 2, '', 2), ('D', 3, '', 3), ('K', 0, 's', 1), ('K', 0, 'u', 2), ('K', 1, 'u', 2), ('K', 2, 'a', 3), ('K', 3, 'u', 2),
  ('R', 0, 'u', 2), ('R', 1, 'u', 2), ('R', 2, 'a', 3), ('R', 3, 'u', 2)) m(letter, s, sym, t)),
added as (select * from (values (0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (0, 2, 1), (0, 3, 2), (1, 2, 1), (1, 3, 2), (2, 3, 1), (3, 2, 1)) a(s, t, n)),
walk as (
  select c, 0::BIGINT as i, t as s, 5 * n as cost, repeat('I', n) as audit from names, added where s = 0
  union all
  select c, i + 1, s, best.cost, best.audit from (
    select w.c, w.i, a.t as s, min(struct_pack(cost := w.cost + 5 * a.n + case m.letter when 'D' then 2 when 'R' then 1 else 0 end
        + case when m.letter <> 'D' and r.fault = 'truncated' then 5 else 0 end, audit := w.audit || m.letter || repeat('I', a.n))) as best
    from walk w join r on r.c = w.c and r.i = w.i + 1 join moves m on m.s = w.s
      and (m.letter = 'D' or r.fault not in ('blank', 'duplicate') and (m.letter = 'R' or m.sym = r.now)) join added a on a.s = m.t
    group by w.c, w.i, a.t)),
final as (select w.c, min(struct_pack(cost := cost, audit := audit)) as best from walk w left join stats using (c) where s in (0, 3) and i = coalesce(len, 0) group by w.c),
letters as (select c, p, best.audit[p] as letter from final, unnest(range(1, len(best.audit) + 1)) as x(p)),
placed as (select *, count(*) filter (letter <> 'I') over (partition by c order by p) as i, count(*) filter (letter <> 'D') over (partition by c order by p) as j from letters),
kept as (select l.*, role, text, first_value(case when letter = 'K' and now = 's' then 1 else 0 end) over (partition by l.c order by p) as off
  from placed l left join r on r.c = l.c and r.i = l.i and letter <> 'I' where letter <> 'D'),
said as (select c, string_agg(case when letter = 'K' then role when (j - off) % 2 = 1 then 'user' else 'assistant' end || ':' || coalesce(text, ''), chr(10) order by p) as lines from kept group by c)
select conv_id, coalesce(gaps, 0)::BIGINT as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, best.cost::BIGINT as cost, best.audit as audit, sha256(coalesce(lines, '')) as repaired_sha256
from names join final using (c) left join stats using (c) left join said using (c)""",
    "op13_periodic_runs": f"""
with d0 as (select row_number() over () as r, doc_id, {_crc32("doc_id::VARCHAR")} as h,
  list_filter(string_split_regex(coalesce(text, ''), {_GAP}), lambda x: x <> '') as w from documents),
d1 as (select *, len(w) as n, coalesce(h % 10 = 0 and len(w) > 0, false) as hit, h // 10 as g from d0),
d2 as (select *, case when hit then g % n end as a from d1),
d3 as (select *, case when hit then 1 + (n - a) // (3 + g % 8) end as p from d2),
x as (select r, i, case when hit and i >= a then w[1 + a + (i - a) % p] else w[1 + i] end as word from d3, unnest(range(0, n)) as t(i)),
same as (select r, b.i - a.i as q, a.i from x a join x b using (r, word) join d3 using (r) where a.i < b.i and 4 * (b.i - a.i) <= n),
isles as (select r, q, i, i - row_number() over (partition by r, q order by i) as k from same),
longest as (select r, q, min(i) as s, count(*) + q as len from isles group by r, q, k having count(*) + q >= greatest(6, 4 * q)),
run as (select r, s, len, min(q) as q from longest group by r, s, len),
gone as (select distinct r, unnest(range(s + q, s + len)) as i from run),
best as (select r, count(*) as n_runs, arg_min(struct_pack(s := s, len := len, q := q), struct_pack(a := -len, b := s, c := q)) as b,
  string_agg(s || ',' || len || ',' || q || chr(10), '' order by s, q) as listed from run group by r),
left_ as (select x.r, string_agg(word, ' ' order by x.i) as kept from x left join gone on gone.r = x.r and gone.i = x.i where gone.i is null group by x.r)
select doc_id, coalesce(n_runs, 0) as n_runs, b.s as start, b.len as length, b.q as period, 1000 * b.len // b.q as exponent_milli,
  sha256(coalesce(listed, '')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256
from d0 left join best using (r) left join left_ using (r)""",
    "op1_line_dedup": f"""
with lines as (
  select doc_id, i, parts[i] as line, {_LOWER.format(f"trim(parts[i], {_SPACE})")} as key
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents),
       unnest(range(1, len(parts) + 1)) as t(i)),
common as (select key from lines where length(key) >= 1 group by key having count(distinct doc_id) >= 10)
select l.doc_id, count(*) as n_lines, count(c.key) as n_dropped,
  sha256(coalesce(string_agg(l.line, chr(10) order by l.i) filter (c.key is null), '')) as kept_sha256
from lines l left join common c on l.key = c.key
group by l.doc_id""",
    "op10_substring_dedup": f"""
with words as (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), {_GAP}), lambda x: x <> '') as w from documents),
windows as (
  select doc_id, i, hash(array_to_string(w[i:i+12], ' ')) as h, md5(array_to_string(w[i:i+12], ' ')) as m
  from words, unnest(range(1, len(w) - 11)) as t(i)),
first as (select h, m, min(doc_id) as owner from windows group by h, m having min(doc_id) < max(doc_id)),
gone as (
  select distinct doc_id, unnest(range(i, i + 13)) as p
  from windows join first using (h, m) where owner < doc_id),
each as (select doc_id, p, w[p] as word from words, unnest(range(1, len(w) + 1)) as t(p))
select d.doc_id, len(d.w) as n_words, count(g.p) as n_removed,
  sha256(coalesce(string_agg(e.word, ' ' order by e.p) filter (g.p is null), '')) as kept_sha256
from words d left join each e using (doc_id) left join gone g on g.doc_id = e.doc_id and g.p = e.p
group by d.doc_id, d.w""",
    "op3_embeddings": """
with recursive e as (select vec_id, list_transform(embedding, lambda x: x::DOUBLE) as v from embeddings),
good as (select vec_id, v from e where len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0
  and len(list_filter(v, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from good a join good b
  on a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.9),
walk as (select vec_id as a, vec_id as b from embeddings union select w.a, l.b from walk w join links l on l.a = w.b),
least as (select a, min(b) as component_id from walk group by a)
select vec_id, (select count(*) from links where a = vec_id) as n_links, component_id, vec_id = component_id as kept
from embeddings join least on a = vec_id""",
    "op8_quality_rules": rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select r, doc_id, t, list_filter(string_split_regex(t, {_GAP}), lambda x: x <> '') as w from d),
l as (select r, i, parts[i] as line, list_filter(string_split_regex(parts[i], {_GAP}), lambda x: x <> '') as lw
  from (select r, string_split(t, chr(10)) as parts from d), unnest(range(1, len(parts) + 1)) as t(i)),
m as (select r, i, line, len(lw) as n, array_to_string(lw, '') as c, {_LOWER.format("line")} as low, {_LOWER.format(f"trim(line, {_SPACE})")} as key,
  len(list_filter(lw, lambda x: suffix(x, '!!') or suffix(x, '??'))) as loud,
  len(lw) between 1 and {rules.MENU_WORDS - 1} and not contains('{"".join(x.decode() for x in rules.STOPS).replace("'", "''")}', right(lw[-1], 1)) as short from l),
f as (select *, n > 0 and (
    4 * (strlen(c) - strlen(regexp_replace(c, '[#*$%&|<>!_=~^{{}}\[\]\\]', '', 'g'))) > strlen(c)
    or n > 3 and 2 * strlen(regexp_replace(c, '[^\x00-\x40\x5b-\x60\x7b-\x7f]', '', 'g')) > strlen(c)
    or n > 2 and 3 * (length(line) - length(regexp_replace(line, '[|>»·›]', '', 'g'))) > n
    or n > 3 and 2 * loud > n
    or n < 30 and ({" or ".join(f"contains(low, '{x.decode()}')" for x in rules.BOILERPLATE)})) as alone,
  i - row_number() over (partition by r, short order by i) as run,
  count(*) over (partition by r, key) as said, row_number() over (partition by r, key order by i) as nth from m),
g as (select *, alone or short and count(*) over (partition by r, short, run) >= {rules.MENU_LINES} or key <> '' and said >= {rules.REPEATS} and nth > 1 as bad from f),
h as (select r, count(*) filter (bad) as n_bad_lines, coalesce(sum(length(c)) filter (bad), 0)::BIGINT as lost_chars,
  count(*) filter (n > 0) - count(distinct line) filter (n > 0) as n_dup_lines from g group by r),
x as (select r, i, array_to_string(w[i:i+4], ' ') as k from w, unnest(range(1, len(w) - 3)) as t(i)),
y as (select r, count(distinct p) as n_repeat_words from (
  select r, unnest(range(i, i + 5)) as p from (select r, i, count(*) over (partition by r, k) as n from x) where n > 1) group by r),
z as (select doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
  n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, n_bad_lines, lost_chars from w join h using (r) left join y using (r)),
v as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from z)
select *, not base_failed and (word_chars = 0 or lost_chars / word_chars::DOUBLE <= 0.3) as kept from v""",
    "op4_warc": f"""
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, strlen(h) as n, sha1(h) as s, max(page_id) over (partition by h) as last from p),
g as (select *, list_transform(range(0, 8), lambda i: ('0x' || substr(s, 5 * i + 1, 5))::BIGINT) as v from d)
select page_id, n as payload_bytes, array_to_string(list_transform(v, lambda x: {" || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> {k}) & 31) + 1, 1)" for k in (15, 10, 5, 0))}), '') as payload_digest,
  case when page_id = last then 'response' else 'revisit' end as record_type, case when page_id <> last then last end as refers_to from g""",
}

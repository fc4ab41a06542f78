"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import fingerprint, licenses, mixing, near, packing, quality, rans, substring, toxicity, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(_documents(spark, sf_dir))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(_documents(spark, sf_dir))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return rows.withColumnRenamed("record_id", "page_id")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.line_first(_documents(spark, sf_dir), cleaned=False)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_rans_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.round_trip(_documents(spark, sf_dir))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(_documents(spark, sf_dir))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.takes(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_edits(_documents(spark, sf_dir))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_classes(_documents(spark, sf_dir)).select("doc_id", "class_id", "class_size", "n_links")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scores(docs, model).select("doc_id", "held_out", "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_warc": op3_warc,
    "op4_quality_rules": op4_quality_rules,
    "op5_rans_ids": op5_rans_ids,
    "op6_license_scan": op6_license_scan,
    "op7_source_mix": op7_source_mix,
    "op8_fingerprints": op8_fingerprints,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_toxicity": op10_toxicity,
}

_W = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL: dict[str, str] = {
    "op1_substring_dedup": f"""with d as (select row_number() over () as r, doc_id, {_W} as w from documents),
s as (select r, unnest(range(1, greatest(1, len(w) - 33))) as i, w from d),
g as (select r, i, array_to_string(list_slice(w, i, i + 34), ' ') as g from s),
twice as (select r, i from (select r, i, count(*) over (partition by g) as n from g) where n > 1),
gone as (select distinct r, i + k as p from twice, (select unnest(range(35)) as k)),
lists as (select r, list(p) as ps, count(*) as n from gone group by r),
kept as (select p.r, string_agg(p.x, ' ' order by p.p) as kept from (select r, unnest(w) as x, generate_subscripts(w, 1) as p from d) p anti join gone on gone.r = p.r and gone.p = p.p group by p.r)
select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join lists using (r) left join kept using (r)""",
    "op3_warc": """with p as (select page_id, octet_length(encode(coalesce(html, ''))) as b, sha1(coalesce(html, '')) as s from pages),
k as (select *, max(page_id) over (partition by s) as top from p)
select page_id, b as payload_bytes, s as payload_digest, case when b >= 1000 and top <> page_id then 'revisit' else 'response' end as record_type, case when b >= 1000 and top <> page_id then top end as refers_to from k""",
    "op4_quality_rules": rf"""with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from d),
g as (select r, i, array_to_string(list_slice(w, i, i + 7), ' ') as g from (select r, unnest(range(1, greatest(1, len(w) - 6))) as i, w from w)),
again as (select r, count(distinct i + k) as n_repeat from (select r, i, count(*) over (partition by r, g) as n from g), (select unnest(range(8)) as k) where n > 1 group by r),
l as (select r, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as i from d),
x as (select r, i, line, lower(line) as low, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as v, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) as chars, row_number() over (partition by r, line order by i) > 1 as seen,
length(line) - length(regexp_replace(line, '[|»›]', '', 'g')) as bars, length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) as symbols from l where regexp_matches(line, '[^\x20\x09-\x0D]')),
m as (select r, i, max(c) as top from (select r, i, u, count(*) as c from (select r, i, unnest(v) as u from x) group by all) group by all),
f as (select r, chars, seen, seen or len(v) <= 10 * len(regexp_extract_all(low, '{quality.NOTICES.pattern}'))
or bars >= 2 and 5 * bars >= len(v) or len(v) <= 12 and 3 * len(regexp_extract_all(low, '{quality.NAVIGATION.pattern}')) >= len(v)
or 10 * symbols > len(v) and symbols >= 3
or len(v) >= 4 and length(line) > 12 and 10 * len(list_filter(v, lambda u: upper(u) = u and lower(u) <> u)) > 7 * len(v)
or len(v) >= 8 and (3 * coalesce(top, 0) > len(v) or 5 * len(list_filter(range(1, len(v)), lambda k: v[k] = v[k + 1])) > 2 * len(v))
or not regexp_matches(line, '[.!?:;…"''”’»)\]。！？][\x20\x09-\x0D]*$') and not regexp_matches(line, '[.!?。]') and len(v) < 5 as fault from x left join m using (r, i)),
k as (select r, sum(case when seen then 1 else 0 end) as dups, sum(case when fault then 0 else chars end) as kept_chars from f group by r),
b as (select doc_id, r, len(w)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
coalesce(dups, 0)::bigint as n_dup_lines, coalesce(n_repeat, 0)::bigint as n_repeat_words, coalesce(kept_chars, 0) as kept_chars from w left join k using (r) left join again using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and kept_chars >= 0.5 * word_chars as kept from b""",
    "op7_source_mix": f"""with d as (select doc_id, source, len({_W})::bigint as size, md5('mix:' || coalesce(doc_id::varchar, 'null')) as at_hash from documents),
a as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as rank from d group by source),
w as (select *, [5, 2, 1][(rank - 1) % 3 + 1]::double as weight, (3 * source_size)::double as cap from a),
l as (select *, ((sum(source_size) over ()) - coalesce(sum(cap) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0)) / (sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0)) as level from w),
t as (select *, least(cap, coalesce(max(case when level <= cap / weight then level end) over (), 0) * weight) as target from l),
r as (select *, round(target)::bigint as stream from t),
n as (select ((sum(stream) + 1023) // 1024)::bigint as slots from r),
h as (select *, least(2147483648, round(sum(target) over (order by rank) / greatest(sum(target) over (), 1) * 2147483648))::bigint as high from r),
i as (select *, coalesce(lag(high) over (order by rank), 0) as low from h),
g as (select rank, row_number() over (partition by rank order by slot) - 1 as j, slot from (select slot, slot * 1327217885 % 2147483648 as point from (select unnest(range(slots)) as slot from n)) join i on point >= low and point < high),
m as (select r.rank, stream, count(g.j) as have, (stream + 1023) // 1024 as need from r left join g using (rank) group by all),
e as (select rank, have, need, (select slots from n) + coalesce(sum(need - have) over (order by rank rows between unbounded preceding and 1 preceding), 0) as base from m where need > have),
f as (select rank, j, slot from g union all select rank, j, base + j - have from (select *, unnest(range(have, need)) as j from e)),
q as (select d.*, source_size, target, stream, rank, coalesce(sum(size) over (partition by d.source order by at_hash, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as pos from d join r on r.source is not distinct from d.source)
select doc_id, size, source_size, target, (case when source_size > 0 then stream // source_size * size + greatest(0, least(size, stream % source_size - pos)) else 0 end)::bigint as taken,
case when size > 0 and pos < stream then slot end::bigint as first_slot from q left join f on f.rank = q.rank and f.j = pos // 1024""",
}

"""DuckDB SQL for those queries of this subpackage that SQL can express over whole tables in reasonable time.

The others have no SQL: spelling variants, place matching and sentences are fuzzy or learned, packing, mixing and
fusion have many right answers. Their tests hold them against brute force, invariants or hand-made cases."""


def _norm(x: str) -> str:
    return rf"trim(regexp_replace(lower(coalesce({x}, '')), '[\s\x{{00A0}}]+', ' ', 'g'))"


_KEY = f"{_norm('org_name')}, {_norm('opportunity_title')}, CASE WHEN {_norm('description_short')} = '' THEN {_norm('description_long')} ELSE {_norm('description_short')} END"
_AT = r"""CASE WHEN regexp_matches(trim(last_scraped), '^-?\d{1,12}$') THEN trim(last_scraped)::bigint * 1000000
 WHEN regexp_matches(trim(last_scraped), '^[A-Za-z]{3} \d{1,2}, \d{4} \d{2}:\d{2} UTC$') THEN epoch_us(try_strptime(trim(last_scraped), '%b %d, %Y %H:%M UTC'))
 WHEN regexp_matches(trim(last_scraped), '^\d{4}-\d{2}-\d{2}') THEN epoch_us(try_cast(regexp_replace(trim(last_scraped), '(:\d{2}(\.\d+)?)(Z|[+-]\d{2}:\d{2})$', '\1') AS timestamp))
  - CASE WHEN regexp_matches(trim(last_scraped), ':\d{2}(\.\d+)?[+-]\d{2}:\d{2}$') THEN (CASE WHEN substr(trim(last_scraped), -6, 1) = '-' THEN -1 ELSE 1 END) * (substr(trim(last_scraped), -5, 2)::bigint * 60 + substr(trim(last_scraped), -2, 2)::bigint) * 60000000 ELSE 0 END END"""
_SAYS = r"(?i)\b(mon|tues?|wed(nes)?|thu(rs?)?|fri|sat(ur)?|sun)(days?)?\b|\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{1,2}\b|\d{4}-\d{1,2}-\d{1,2}|\b\d{1,2}:\d{2}"
_SETS = r"""SELECT ord, unnest(list_distinct(regexp_extract_all(lower(concat_ws(' ', org_name, opportunity_title, description_long)), '[\p{{L}}\p{{N}}]+'))) AS w FROM {t} WHERE trim(coalesce(description_long, '')) <> ''"""
_WORDS = _SETS.format(t="volops_dallasdoinggood")
_ALL = f"{_WORDS} UNION ALL {_SETS.format(t='volops_batches')}"
_UNIT = "SELECT row_no, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM opportunities WHERE embedding IS NOT NULL AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0"

_SEEN = f"""WITH w AS ({_ALL}), n AS (SELECT ord, count(*) AS n FROM w GROUP BY ord), b AS (SELECT ord FROM volops_batches),
p AS (SELECT s.ord AS seen_ord, x.ord AS new_ord, count(*) AS c FROM w x JOIN w s ON s.w = x.w AND s.ord < x.ord WHERE x.ord IN (SELECT ord FROM b) GROUP BY 1, 2),
alike AS (SELECT seen_ord, new_ord FROM p JOIN n a ON a.ord = seen_ord JOIN n z ON z.ord = new_ord WHERE c >= 0.7 * (a.n + z.n - c) - 1e-9),
i AS (SELECT ord, lower(trim(id)) AS k FROM (SELECT ord, id FROM volops_dallasdoinggood UNION ALL SELECT ord, id FROM volops_batches) WHERE trim(id) <> '')
SELECT seen_ord, new_ord FROM alike UNION SELECT s.ord, x.ord FROM i x JOIN i s ON s.k = x.k AND s.ord < x.ord WHERE x.ord IN (SELECT ord FROM b)"""

ORACLE: dict[str, str] = {
    "p1_found": f"""WITH r AS (SELECT v.ord, md5(concat_ws(chr(0), {_KEY})) AS k, s.rank, coalesce({_AT}, -(1::bigint << 62)) AS at_, regexp_matches(coalesce(v.schedule.raw, ''), '{_SAYS}') AS says
 FROM volops_dallasdoinggood v LEFT JOIN (SELECT lower(trim(source)) AS source, min(trust_rank) AS rank FROM source_ranks GROUP BY 1) s ON {_norm('v.source')} = s.source)
SELECT min(ord) AS group_ord, arg_max(ord, (-coalesce(rank, 1000000), at_, -ord)) AS source_ord, arg_max(ord, (at_, -ord)) AS scraped_ord, coalesce(arg_max(ord, (at_, -ord)) FILTER (says), -1) AS schedule_ord FROM r GROUP BY k HAVING count(*) > 1""",
    "p2_found": _SEEN,
    "p2_batches": f"SELECT batch_no, count(*) AS n_pairs, count(DISTINCT new_ord) AS n_seen FROM ({_SEEN}) JOIN (SELECT ord AS new_ord, batch_no FROM volops_batches) USING (new_ord) GROUP BY batch_no",
    "p3_found": f"""WITH w AS ({_WORDS}), n AS (SELECT ord, count(*) AS n FROM w GROUP BY ord), p AS (SELECT a.ord AS ord_a, b.ord AS ord_b, count(*) AS c FROM w a JOIN w b ON a.w = b.w AND a.ord < b.ord GROUP BY 1, 2)
SELECT ord_a, ord_b FROM p JOIN n x ON x.ord = ord_a JOIN n y ON y.ord = ord_b WHERE c >= 0.7 * (x.n + y.n - c) - 1e-9""",
    "p5_found": f"""WITH u AS ({_UNIT}), s AS (SELECT a.row_no AS q, b.row_no AS r, row_number() OVER (PARTITION BY a.row_no ORDER BY round(list_dot_product(a.v, b.v) / (a.n * b.n), 12) DESC, b.row_no) AS k FROM u a JOIN u b ON a.row_no <> b.row_no)
SELECT DISTINCT least(q, r) AS row_a, greatest(q, r) AS row_b FROM s WHERE k <= 8""",
}

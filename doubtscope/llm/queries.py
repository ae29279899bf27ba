"""Registered queries of the operators: name → function of (spark, sf_dir), and SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doubtscope.llm import ann, clusters, decontam, html, language, lmscore, mixing, periodic, personal, secrets, sharding, simhash, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spans_sql(kind: str, pattern: str, group: int = 0) -> str:
    """List of (kind, s, e, whole, value) of the matches of an RE2 pattern in column t."""
    quoted = pattern.replace("'", "''")
    return f"""list_transform(
      list_zip(range(len(regexp_extract_all(t, '{quoted}'))), regexp_extract_all(t, '{quoted}'), regexp_extract_all(t, '{quoted}', {group})),
      lambda z: struct_pack(kind := '{kind}',
        s := list_sum(list_transform(string_split_regex(t, '{quoted}')[1 : z[1] + 1], lambda x: length(x)))
           + coalesce(list_sum(list_transform(regexp_extract_all(t, '{quoted}')[1 : z[1]], lambda x: length(x))), 0),
        whole := z[2], value := z[3]))"""


_NAMED = "array_to_string(list_transform({}, lambda x: x.kind || ':' || x.s || ':' || x.e), ',')"

_SECRETS_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS owner, coalesce(doc_id::VARCHAR, '') AS repo, coalesce(text, '') AS t FROM documents),
raw AS (SELECT rid, doc_id, owner, repo, unnest(list_concat(
  list_filter({_spans_sql("assign", secrets.PATTERNS["assign"][0], 2)}, lambda x: length(x.value) >= 6),
  {_spans_sql("access", "AKIA[A-Z0-9]{16,}")}, {_spans_sql("hex", "[0-9a-f]{24,}")},
  list_filter({_spans_sql("opaque", "[A-Za-z0-9+/_=-]{20,}")}, lambda x: regexp_matches(x.value, '[0-9]') AND regexp_matches(x.value, '[a-z]') AND regexp_matches(x.value, '[A-Z]')))) AS f FROM docs),
flat AS (SELECT rid, doc_id, owner, repo, f.kind AS kind, f.s::BIGINT AS s, (f.s + length(f.whole))::BIGINT AS e, sha256(f.value) AS h,
  list_position(['assign', 'access', 'hex', 'opaque'], f.kind) AS rank FROM raw),
spans AS (SELECT * FROM flat a WHERE kind <> 'opaque' OR NOT EXISTS (SELECT 1 FROM flat b WHERE b.rid = a.rid AND b.kind <> 'opaque' AND b.s < a.e AND a.s < b.e)),
owners AS (SELECT h, count(DISTINCT owner) AS n_owners FROM spans GROUP BY h),
told AS (SELECT spans.*, n_owners >= 2 AS copied FROM spans JOIN owners USING (h) WHERE kind <> 'opaque' OR n_owners < 2),
kept AS (SELECT rid, list(struct_pack(kind := kind, s := s, e := e, copied := copied) ORDER BY s, rank) AS f FROM told GROUP BY rid),
whole AS (SELECT doc_id, coalesce(f, []) AS f FROM docs LEFT JOIN kept USING (rid))
SELECT doc_id, len(list_filter(f, lambda x: x.kind = 'assign'))::BIGINT AS n_assign, len(list_filter(f, lambda x: x.kind = 'access'))::BIGINT AS n_access,
  len(list_filter(f, lambda x: x.kind = 'hex'))::BIGINT AS n_hex,
  sha256({_NAMED.format("list_filter(f, lambda x: x.kind <> 'opaque')")}) AS base_sha256, {_NAMED.format("f")} AS spans,
  len(list_filter(f, lambda x: x.copied))::BIGINT AS n_copied, len(list_filter(f, lambda x: NOT x.copied))::BIGINT AS n_live
FROM whole"""


@_query("op1_secret_scan", _SECRETS_SQL)
def op1_secret_scan(spark, sf_dir):
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents")))


_LUHN = """list_sum(list_transform(range(length({0})), lambda i: CASE WHEN i % 2 = 0 THEN substr(reverse({0}), i + 1, 1)::INT
  ELSE (substr(reverse({0}), i + 1, 1)::INT * 2) // 10 + (substr(reverse({0}), i + 1, 1)::INT * 2) % 10 END)) % 10 = 0"""
_IBAN = "regexp_replace(x.whole, ' ', '', 'g')"
_MOD97 = f"""list_reduce(list_prepend(0, list_transform(range(length({_IBAN})), lambda i: ascii(substr(substr({_IBAN}, 5) || substr({_IBAN}, 1, 4), i + 1, 1)))),
  lambda r, c: (CASE WHEN c >= 65 THEN r * 100 + c - 55 ELSE r * 10 + c - 48 END) % 97) = 1"""
_CONFIRM = {
    "email": ("[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+", "true"),
    "ip": ("[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)", "list_max(list_transform(string_split(x.whole, '.'), lambda p: p::HUGEINT)) <= 255"),
    "card": (
        "[0-9]([\\x20-]?[0-9])+",
        f"length(regexp_replace(x.whole, '[^0-9]', '', 'g')) BETWEEN 13 AND 19 AND {_LUHN.format("regexp_replace(x.whole, '[^0-9]', '', 'g')")}",
    ),
    "phone": ("\\+[0-9][\\x20().0-9-]+[0-9]", "length(regexp_replace(x.whole, '[^0-9]', '', 'g')) BETWEEN 9 AND 15"),
    "iban": ("\\b[A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]{4}){2,7}(?:\\x20?[A-Z0-9]{1,3})?\\b", _MOD97),
}


def _personal_kind(kind: str) -> str:
    pattern, check = _CONFIRM[kind]
    near = f"substr(t, greatest(x.s - {personal.NEAR}, 0)::BIGINT + 1, least(x.s, {personal.NEAR})::BIGINT) || ' ' || substr(t, (x.s + length(x.whole))::BIGINT + 1, {personal.NEAR})"
    score = f"{personal.SCORES[kind]} + CASE WHEN regexp_matches(lower({near}), '{personal.CONTEXT[kind]}') THEN {personal.RAISE} ELSE 0 END"
    return f"""list_transform(list_filter({_spans_sql(kind, pattern)}, lambda x: {check}),
      lambda x: struct_pack(kind := x.kind, s := x.s::BIGINT, e := (x.s + length(x.whole))::BIGINT, score := {score}))"""


_PERSONAL_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (SELECT doc_id, list_concat({", ".join(_personal_kind(k) for k in personal.KINDS)}) AS f FROM docs)
SELECT doc_id, {", ".join(f"len(list_filter(f, lambda x: x.kind = '{k}'))::BIGINT AS n_{k}" for k in personal.BASE)},
  sha256({_NAMED.format("list_filter(f, lambda x: x.kind <> 'iban')")}) AS base_sha256, {_NAMED.format("f")} AS spans,
  coalesce(list_sum(list_transform(f, lambda x: x.score)), 0)::BIGINT AS score_sum
FROM found"""


@_query("op3_personal_data", _PERSONAL_SQL)
def op3_personal_data(spark, sf_dir):
    return personal.digest(personal.find_personal(_table(spark, sf_dir, "documents")))


@_query("op4_simhash")
def op4_simhash(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def _fill_sql(shards: list[str], size: int) -> str:
    """Recursive SQL for sharding.fill_table: (slot, shard), one turn after the other."""
    names = ", ".join(f"({k}, '{s}')" for k, s in enumerate(shards))
    number = "('0x' || substr(md5('{}:' || shard), 1, 12))::BIGINT"
    return f"""
  names(k, shard) AS (VALUES {names}),
  orders AS (SELECT k, shard, {number.format("offset")} % {size} AS start, {number.format("stride")} % {size - 1} + 1 AS stride FROM names),
  walks AS (SELECT k, shard, list_transform(range({size}), lambda j: (start + j * stride) % {size}) AS walk FROM orders),
  fill(turn, slot, taken, steps) AS (
    SELECT -1, -1::BIGINT, []::BIGINT[], list_transform(range({len(shards)}), lambda j: 0)
    UNION ALL
    SELECT f.turn + 1, w.walk[p.j], f.taken || [w.walk[p.j]],
      list_transform(f.steps, lambda x, i: CASE WHEN i = w.k + 1 THEN p.j ELSE x END)
    FROM fill f JOIN walks w ON w.k = (f.turn + 1) % {len(shards)}
    CROSS JOIN LATERAL (
      SELECT f.steps[w.k + 1] + list_position(list_transform(w.walk[f.steps[w.k + 1] + 1 : {size}], lambda s: NOT list_contains(f.taken, s)), true) AS j
    ) p
    WHERE f.turn + 1 < {size}
  ),
  placed AS (SELECT slot, (SELECT shard FROM names WHERE k = turn % {len(shards)}) AS shard FROM fill WHERE turn >= 0)"""


SHARDS, SLOTS = [f"shard-{k:02d}" for k in range(32)], 1021


@_query(
    "op5_sharding",
    f"""WITH RECURSIVE {_fill_sql(SHARDS, SLOTS)}
SELECT d.doc_id, d.slot::INT AS slot, p.shard FROM (
  SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT % {SLOTS} AS slot FROM documents) d
JOIN placed p ON p.slot = d.slot""",
)
def op5_sharding(spark, sf_dir):
    return sharding.assign_shards(_table(spark, sf_dir, "documents").select("doc_id"), SHARDS, SLOTS)


def _mix_sql(powers: dict[str, float], rounds: int, seed: int, share: float) -> str:
    steps, last = [], "w0"
    for k in range(rounds * 3):
        d = mixing.DIMENSIONS[k % 3]
        steps.append(
            f"w{k + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, least(weight * target / sum(weight) OVER (PARTITION BY {d}), tokens / ({share} * (SELECT sum(tokens)::DOUBLE FROM cells))) AS weight FROM w{k} JOIN t_{d} USING ({d}))"
        )
        last = f"w{k + 1}"
    targets = ", ".join(
        f"t_{d} AS (SELECT {d}, share / sum(share) OVER () AS target FROM (SELECT {d}, pow(sum(tokens)::DOUBLE, {powers[d]}) AS share FROM cells GROUP BY {d}))"
        for d in mixing.DIMENSIONS
    )
    return f"""WITH marked AS (
  SELECT doc_id, coalesce(source, '{mixing.MISSING}') AS source, coalesce(lang, '{mixing.MISSING}') AS lang,
    CASE WHEN contains(t, ' | ') THEN 'tabular' WHEN length(t) < 400 THEN 'note' WHEN length(t) < 4000 THEN 'article' ELSE 'essay' END AS topic,
    greatest(len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')), 1) AS tokens
  FROM (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents)),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM marked GROUP BY ALL),
{targets},
w0 AS (SELECT *, tokens / (SELECT sum(tokens)::DOUBLE FROM cells) AS weight FROM cells),
{", ".join(steps)},
ranked AS MATERIALIZED (SELECT *, weight / tokens AS rate, row_number() OVER (ORDER BY weight / tokens DESC, source, lang, topic) AS k FROM {last}),
steps AS (SELECT k, sum(tokens) OVER (ORDER BY k) AS whole, (SELECT sum(weight) FROM ranked) - sum(weight) OVER (ORDER BY k) AS rest, lead(rate) OVER (ORDER BY k) AS next FROM ranked
  UNION ALL SELECT 0, 0, sum(weight), max(rate) FROM ranked),
scales AS (SELECT k, ({share} * (SELECT sum(tokens)::DOUBLE FROM cells) - whole) / rest AS scale, next FROM steps WHERE next IS NOT NULL),
rates AS (SELECT source, lang, topic, least(1, rate * (SELECT scale FROM scales WHERE scale * next < 1 ORDER BY k LIMIT 1)) AS p FROM ranked)
SELECT doc_id, source, lang, topic, tokens::BIGINT AS tokens, round(p, 6) AS p
FROM marked JOIN rates USING (source, lang, topic)
WHERE ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE / {1 << 48}.0 < p"""


@_query("op7_mixing", _mix_sql(mixing.POWERS, 6, 7, mixing.SHARE))
def op7_mixing(spark, sf_dir):
    mixed = mixing.sample_mixture(_table(spark, sf_dir, "documents"), share=mixing.SHARE).where("__kept")
    return mixed.select("doc_id", "__mix.source", "__mix.lang", "__mix.topic", "__mix.tokens", F.round("__p", 6).alias("p"))


@_query("op8_decontamination")
def op8_decontamination(spark, sf_dir):
    return decontam.contaminated_pairs(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query("op10_language")
def op10_language(spark, sf_dir):
    return language.identify(_table(spark, sf_dir, "documents"))


@_query("op2_main_text")
def op2_main_text(spark, sf_dir):
    return html.main_text(_table(spark, sf_dir, "pages"))


@_query(
    "op6_warc",
    """WITH sized AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages),
firsts AS (SELECT h, min(page_id) AS first_id FROM sized WHERE n >= 100 GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest,
  CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM sized LEFT JOIN firsts USING (h)""",
)
def op6_warc(spark, sf_dir):
    index = warc.archive_pages(_table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query("op9_nearest")
def op9_nearest(spark, sf_dir):
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def _cluster_sql(k: int, rounds: int, seed: int) -> str:
    apart = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT rid, min((d, num)) AS best FROM (SELECT rid, num, {apart} AS d FROM kept, c{r}) GROUP BY rid)")
        if r < rounds:
            moved = f"SELECT num, list(m ORDER BY j) AS c FROM (SELECT best[2] AS num, j, floor_div(sum(x), count(*)) AS m FROM (SELECT best, unnest(v) AS x, unnest(range(64)) AS j FROM a{r} JOIN kept USING (rid)) GROUP BY ALL) GROUP BY num"
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT num, coalesce(n.c, o.c) AS c FROM c{r} o LEFT JOIN ({moved}) n USING (num))")
    steps = ",\n".join(steps).replace("floor_div(sum(x), count(*))", "((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT")
    return f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {clusters.SCALE})::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::VARCHAR) NULLS LAST, v) - 1 AS num, v AS c FROM kept ORDER BY num LIMIT {k}),
{steps},
told AS (SELECT rid, vec_id, best[2] AS num, best[1] AS distance FROM a{rounds} JOIN kept USING (rid))
SELECT vec_id, num::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY num))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM told JOIN c{rounds} USING (num)"""


@_query("op11_centroid_clusters", _cluster_sql(8, 10, 3))
def op11_centroid_clusters(spark, sf_dir):
    return clusters.digest(*clusters.cluster(_table(spark, sf_dir, "embeddings"), dim=64, k=8, rounds=10, seed=3))


#: Equal words at a distance of q, counted as islands; the smallest of the periods that share a stretch is the run's.
_RUNS_SQL = """WITH given AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ord(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS h FROM documents),
sized AS (SELECT *, len(w) AS n, h // 10 AS g FROM given),
placed AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM sized),
docs AS (SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_concat(w[1 : a], list_transform(range(n - a), lambda i: w[a + i % (1 + (n - a) // (3 + g % 8)) + 1])) ELSE w END AS w FROM placed),
words AS (SELECT rid, n, unnest(w) AS w, unnest(range(n)) AS i FROM docs),
equal AS (SELECT x.rid, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.rid = y.rid AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT rid, q, min(i) AS s, count(*) + q AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM equal) GROUP BY rid, q, island),
runs AS MATERIALIZED (SELECT rid, s, n, min(q) AS q FROM islands WHERE n >= greatest(6, 4 * q) GROUP BY rid, s, n),
told AS (SELECT rid, count(*) AS n_runs, min((-(n / q), s, q, n)) AS best, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY rid),
cut AS (SELECT DISTINCT rid, unnest(range(s + q, s + n)) AS i FROM runs),
kept AS (SELECT rid, string_agg(w, ' ' ORDER BY i) AS t FROM words ANTI JOIN cut USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best[2]::BIGINT AS start, best[4]::BIGINT AS length, best[3]::BIGINT AS period,
  (1000 * best[4] // best[3])::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM docs LEFT JOIN told USING (rid) LEFT JOIN kept USING (rid)"""


@_query("op12_periodic_runs", _RUNS_SQL)
def op12_periodic_runs(spark, sf_dir):
    return periodic.digest(periodic.with_runs(periodic.repeated_words(_table(spark, sf_dir, "documents"))))


@_query("op13_lm_score")
def op13_lm_score(spark, sf_dir):
    return lmscore.score(_table(spark, sf_dir, "documents"))

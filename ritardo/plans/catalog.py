"""Catalogue, key and quality-gate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ritardo.functions import keys as K
from ritardo.operators import quality as Q
from ritardo.operators import tables as T
from ritardo.operators.ordered import scan
from ritardo.plans.consensus import rnd
from ritardo.plans.registry import query
from ritardo.plans.standins import notes, score, sql, table, takes
from ritardo.sources import catalog as C
from ritardo.sources import readers as R

P = ["performance_id"]


# ------------------------------------------------------------------ keys

@query("fold_slug", """
SELECT doc_id, md5(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '', 'g')) AS slug_md5
FROM documents""")
def fold_slug(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(K.slug(F.col("text"))).alias(
        "slug_md5"))


TITLES = """t AS (SELECT p_partkey, p_size,
  CASE p_partkey % 7 WHEN 0 THEN 'Bach,_Johann' WHEN 1 THEN 'Chopin,_Frédéric' WHEN 2 THEN 'Mozart,_W.'
    WHEN 3 THEN 'Haydn' WHEN 4 THEN 'Dvořák,_Antonín' WHEN 5 THEN 'Beethoven' ELSE 'Schubert,_Franz' END AS composer,
  CASE p_partkey % 5 WHEN 0 THEN 'Sonata_in_C,_Op.' || p_size || '_No.' || (p_partkey % 4 + 1)
    WHEN 1 THEN 'Suite,_K.' || p_size || '_D.' || p_size WHEN 2 THEN 'Etudes,_Op._' || p_size
    WHEN 3 THEN 'Sonata,_Hob.XVI:' || p_size ELSE p_name END AS composition,
  CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN (p_size % 4 + 1) || '._Allegro'
    WHEN 2 THEN 'No.' || (p_size % 9 + 1) || '_in_G' WHEN 3 THEN 'BWV_' || p_size || '_Fugue'
    WHEN 4 THEN '3._Adagio_-_4._Allegro' ELSE 'Prelude' END AS movement
  FROM part)"""


def titles(spark, sf):
    p = table(spark, sf, "part")
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")

    def pick(n, *vals):
        return F.element_at(F.array(*[v if not isinstance(v, str) else F.lit(v) for v in vals]),
                            (k % n + 1).cast("int"))

    return p.select(
        "p_partkey", "p_size",
        pick(7, "Bach,_Johann", "Chopin,_Frédéric", "Mozart,_W.", "Haydn", "Dvořák,_Antonín",
             "Beethoven", "Schubert,_Franz").alias("composer"),
        pick(5, F.concat(F.lit("Sonata_in_C,_Op."), size, F.lit("_No."), (k % 4 + 1).cast(
            "string")), F.concat(F.lit("Suite,_K."), size, F.lit("_D."), size),
            F.concat(F.lit("Etudes,_Op._"), size), F.concat(F.lit("Sonata,_Hob.XVI:"), size),
            F.col("p_name")).alias("composition"),
        pick(6, "", F.concat((F.col("p_size") % 4 + 1).cast("string"), F.lit("._Allegro")),
             F.concat(F.lit("No."), (F.col("p_size") % 9 + 1).cast("string"), F.lit("_in_G")),
             F.concat(F.lit("BWV_"), size, F.lit("_Fugue")), "3._Adagio_-_4._Allegro",
             "Prelude").alias("movement"))


def with_ids(spark, sf):
    return K.with_catalogue_piece_id(titles(spark, sf), "part", "composer", "composition",
                                     "movement")


PIECE_IDS = TITLES + """, x AS (SELECT *, strip_accents(split_part(composer, ',', 1)) AS sn,
  'part:' || composer || CASE WHEN composition <> '' THEN '/' || composition ELSE '' END
    || CASE WHEN movement <> '' THEN '/' || movement ELSE '' END AS fb,
  nullif(regexp_extract(movement, 'BWV[\\s_.]*(\\d+[a-z]?)', 1), '') AS bwv,
  CASE strip_accents(split_part(composer, ',', 1))
    WHEN 'Bach' THEN 'bwv' || nullif(regexp_extract(composition, 'BWV[\\s_.]*(\\d+[a-z]?)', 1), '')
    WHEN 'Mozart' THEN 'k' || nullif(regexp_extract(composition, '(^|[^A-Za-z])K\\.[\\s_]*(\\d+[a-z]?)', 2), '')
    WHEN 'Schubert' THEN 'd' || nullif(regexp_extract(composition, '(^|[^A-Za-z])D\\.[\\s_]*(\\d+)', 2), '')
    WHEN 'Haydn' THEN 'hob' || nullif(lower(regexp_extract(composition, 'Hob\\.[\\s_]*(XVI+)[:.]?(\\d+)', 1)), '')
      || nullif(regexp_extract(composition, 'Hob\\.[\\s_]*(XVI+)[:.]?(\\d+)', 2), '') END AS own,
  nullif(regexp_extract(composition, '(?i)(^|[^A-Za-z])Op\\.[\\s_]*(\\d+[a-z]?)', 2), '') AS op,
  nullif(regexp_extract(composition, '(?i)(^|[^A-Za-z])Op\\.[\\s_]*(\\d+[a-z]?)[\\s_,]*No\\.[\\s_]*(\\d+)', 3), '') AS opno,
  regexp_matches(composition, '(?i)Sonat|Concert|Suite|Partita|Symphon|Fantasie_in') AS multi,
  nullif(regexp_extract(movement, '^(\\d+)\\.', 1), '') AS ml,
  nullif(regexp_extract(movement, '^No\\.[\\s_]*(\\d+)', 1), '') AS mb FROM t),
y AS (SELECT *, coalesce(own, 'op' || op) AS cat, CASE WHEN own IS NULL AND op IS NOT NULL THEN opno END AS num FROM x),
z AS (SELECT *, CASE
  WHEN sn = 'Bach' AND bwv IS NOT NULL THEN 'bach_bwv' || bwv ||
    CASE WHEN movement LIKE '%Fugue' THEN '_fugue' WHEN movement LIKE '%Prelude' THEN '_prelude' ELSE '' END
  WHEN cat IS NULL OR regexp_matches(movement, '_-_\\d+\\.') THEN fb
  WHEN movement = '' THEN lower(sn) || '_' || cat || coalesce('_no' || num, '')
  WHEN ml IS NOT NULL AND multi THEN lower(sn) || '_' || cat || coalesce('_no' || num, '') || '_mv' || ml
  WHEN ml IS NOT NULL AND num IS NULL THEN lower(sn) || '_' || cat || '_no' || ml
  WHEN ml IS NOT NULL THEN fb
  WHEN mb IS NOT NULL AND num IS NULL THEN lower(sn) || '_' || cat || '_no' || mb
  ELSE fb END AS piece_id FROM y)"""


@query("catalogue_piece_id", "WITH " + PIECE_IDS + " SELECT p_partkey, piece_id FROM z")
def catalogue_piece_id(spark, sf):
    return with_ids(spark, sf).select("p_partkey", "piece_id")


@query("piece_ids_demoted", "WITH " + PIECE_IDS + """
, u AS (SELECT DISTINCT composer, composition, movement, piece_id FROM z),
n AS (SELECT piece_id, count(*) AS n FROM u GROUP BY 1)
SELECT p_partkey, CASE WHEN n > 1 AND NOT contains(piece_id, ':') THEN fb ELSE piece_id END AS piece_id
FROM z JOIN n USING (piece_id) WHERE p_size > 10""")
def piece_ids_demoted(spark, sf):
    c = [F.col(x) for x in ("composer", "composition", "movement")]
    t = with_ids(spark, sf)
    t = C.demote_ambiguous(t, ["composer", "composition", "movement"], "piece_id",
                           K.prefixed_piece_id("part", *c))
    return t.where("p_size > 10").select("p_partkey", "piece_id")


@query("performer_ids", """
SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'crm:' || replace(c_name, '#', '_')
  ELSE 'crm:unknown/' || c_custkey END AS performer_id FROM customer""")
def performer_ids(spark, sf):
    c = table(spark, sf, "customer")
    name = F.when(F.col("c_acctbal") > 0, F.replace("c_name", F.lit("#"), F.lit("  ")))
    return c.select("c_custkey", K.performer_id("crm", name, F.col("c_custkey")).alias(
        "performer_id"))


@query("work_keys", "WITH " + PIECE_IDS + """
SELECT p_partkey, CASE
  WHEN contains(piece_id, ':') AND len(string_split(piece_id, '/')) >= 3 AND multi
    THEN 'part:' || composer || '/' || composition
  WHEN contains(piece_id, ':') THEN piece_id
  ELSE regexp_replace(piece_id, '_(mv\\d+(?:to\\d+)?|prelude|fugue)$', '') END AS work,
  regexp_extract(lower(strip_accents(split_part(composer, ',', 1))), '[a-z]+$') AS surname FROM z""")
def work_keys(spark, sf):
    return with_ids(spark, sf).select(
        "p_partkey", K.work_key(F.col("piece_id"), F.col("composition")).alias("work"),
        K.composer_surname(F.col("composer")).alias("surname"))


@query("catalogue_tokens", "WITH " + TITLES + """
, f AS (SELECT p_partkey, lower(strip_accents(composition || ' ' || movement)) AS s FROM t),
c AS (SELECT p_partkey, list_concat(
  list_transform(regexp_extract_all(' ' || s, '[^a-z]((op|bwv|k|d|s|l|woo|hob)\\.?[\\s_.]*((?:[ivxlc]+[:.]?[\\s_]*)?\\d+[a-z]?))', 1),
    lambda x: regexp_replace(x, '[\\s_.:]', '', 'g')),
  list_transform(regexp_extract_all(' ' || s, '[^a-z]no\\.?[\\s_]*(\\d+)', 1), lambda x: 'no' || x)) AS toks FROM f)
SELECT p_partkey, array_to_string(list_sort(list_distinct(toks)), ' ') AS tokens FROM c""")
def catalogue_tokens(spark, sf):
    text = F.concat_ws(" ", "composition", "movement")
    return titles(spark, sf).select("p_partkey", F.concat_ws(
        " ", K.catalogue_tokens(text)).alias("tokens"))


@query("piece_slug", "WITH " + PIECE_IDS + """
SELECT p_partkey, CASE WHEN regexp_full_match(piece_id, '[a-z0-9_]+') THEN piece_id ELSE
  substr(trim(regexp_replace(lower(strip_accents(piece_id)), '[^a-z0-9]+', '_', 'g'), '_'), 1, 80)
  || '_' || substr(sha1(piece_id), 1, 8) END AS slug FROM z""")
def piece_slug(spark, sf):
    return with_ids(spark, sf).select("p_partkey", K.piece_slug(F.col("piece_id")).alias("slug"))


@query("pitch_names", sql("score", """
SELECT score_id, note_id, ['C', 'C#', 'D', 'Eb', 'E', 'F', 'F#', 'G', 'Ab', 'A', 'Bb', 'B'][pitch % 12 + 1]
  || (pitch // 12 - 1) AS name, CASE WHEN staff = 1 THEN 'R' ELSE 'L' END AS staff_hand,
  CASE WHEN pitch >= 60 THEN 'R' ELSE 'L' END AS split_hand FROM score"""))
def pitch_names(spark, sf):
    return score(spark, sf).select(
        "score_id", "note_id", K.pitch_name(F.col("pitch")).alias("name"),
        K.staff_hand(F.col("staff")).alias("staff_hand"),
        K.pitch_split_hand(F.col("pitch")).alias("split_hand"))


@query("metrical_strength", sql("score", """
, m AS (SELECT *, quantity % 14 + 1 AS nb, CASE WHEN status = 'O' THEN 8 ELSE 4 END AS bt,
  (onset_uq // 2000000 % 24) * 500000 AS pos FROM score),
c AS (SELECT *, nb IN (6, 9, 12) AND bt >= 8 AS cp FROM m)
SELECT score_id, note_id, CASE WHEN pos = 0 THEN 1.0::DOUBLE
  WHEN (cp AND nb = 12 AND pos % 6000000 = 0) OR (NOT cp AND nb = 4 AND pos % 2000000 = 0) THEN 0.75::DOUBLE
  WHEN pos % (CASE WHEN cp THEN 3000000 ELSE 1000000 END) = 0 THEN 0.5::DOUBLE
  WHEN pos % (CASE WHEN cp THEN 1000000 ELSE 500000 END) = 0 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS strength FROM c"""))
def metrical_strength(spark, sf):
    s = score(spark, sf)
    pos = F.expr("((onset_uq div 2000000) % 24) * 500000")
    bt = F.when(F.col("status") == "O", 8).otherwise(4)
    return s.select("score_id", "note_id", K.metrical_strength(
        pos, F.col("quantity") % 14 + 1, bt).alias("strength"))


@query("base_note_ids", sql("score", """
SELECT score_id, note_id, regexp_replace(note_id, '-\\d+$', '') AS base,
  coalesce(CAST(nullif(regexp_extract(note_id, '-(\\d+)$', 1), '') AS BIGINT), 0) AS pass FROM score"""))
def base_note_ids(spark, sf):
    base, n = K.base_note_id(F.col("note_id"))
    return score(spark, sf).select("score_id", "note_id", base.alias("base"),
                                   n.cast("bigint").alias("pass"))


@query("quick_decisions", """
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' OR o_orderpriority LIKE '1%'
    THEN CASE WHEN o_totalprice / 500000 < 0.3 THEN 'stop' ELSE 'pass' END
  WHEN o_custkey % 100 < 40 THEN 'confirm' WHEN o_totalprice / 500000 < 0.5 THEN 'stop' ELSE 'pass' END AS decision
FROM orders""")
def quick_decisions(spark, sf):
    o = table(spark, sf, "orders")
    d = K.quick_decision(
        F.col("o_totalprice") / 500000, F.col("o_orderstatus") == "P",
        F.col("o_orderpriority").startswith("1"), F.col("o_custkey") % 100, stop=0.3,
        partial_stop=0.5, min_notes=40)
    return o.select("o_orderkey", d.alias("decision"))


@query("clean_text", """
WITH a AS (SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS t FROM pages),
b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'),
  '&quot;', '"'), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS t FROM a),
c AS (SELECT page_id, trim(regexp_replace(replace(regexp_replace(t, '[\\p{Co}\\p{Cc}\\p{Cf}]', '', 'g'),
  'space', ''), '\\s+', ' ', 'g')) AS t FROM b)
SELECT page_id, md5(CASE WHEN regexp_matches(t, '[\\p{L}\\p{N}]') THEN t ELSE '' END) AS text_md5 FROM c""")
def clean_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(K.clean_text(F.col("html"))).alias(
        "text_md5"))


@query("untested_genres", """
SELECT page_id, CASE WHEN contains(lower(url), 'blog') THEN 'blog' ELSE '' END AS genre_host,
  CASE WHEN contains(lower(html), 'nocturne') THEN 'nocturne' WHEN contains(lower(html), 'waltz') THEN 'waltz'
    WHEN contains(lower(html), 'valse') THEN 'waltz' ELSE '' END AS genre FROM pages""")
def untested_genres(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", F.when(F.lower("url").contains("blog"), "blog").otherwise("").alias(
        "genre_host"), K.untested_genre(F.col("html")).alias("genre"))


@query("shares_with_intervals", sql("notes", """
, a AS (SELECT performance_id, count(*) FILTER (k < 30) AS h, count(*) AS n FROM notes GROUP BY 1),
b AS (SELECT *, h / n AS p FROM a), z AS (SELECT *, 1.959964 AS z FROM b)
SELECT performance_id, round((p - 0.01) / (1 - 0.02), 9) AS corrected,
  round(3 * p / (1 + 2 * p), 9) AS reliability3,
  round(((p + z * z / (2 * n)) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) AS low,
  round(((p + z * z / (2 * n)) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) AS high
FROM z"""))
def shares_with_intervals(spark, sf):
    from ritardo.functions import stats as S

    a = notes(spark, sf).groupBy("performance_id").agg(
        F.count(F.when(F.col("k") < 30, 1)).alias("h"), F.count("*").alias("n"))
    p = F.col("h") / F.col("n")
    lo, hi = S.wilson(F.col("h"), F.col("n"))
    return rnd(a.select("performance_id", S.noise_corrected(p, F.lit(0.01)).alias("corrected"),
                        S.spearman_brown(p, 3).alias("reliability3"), lo.alias("low"),
                        hi.alias("high")), 9, "corrected", "reliability3", "low", "high")


# ------------------------------------------------------------------ catalogue tables

@query("piece_notes_scan", sql("notes", """
SELECT performance_id, note_id, event_type AS piece_id, pitch, label FROM notes n
WHERE label IN ('match', 'insertion')
  AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.toxic = 1 AND l.doc_id = n.performance_id)"""))
def piece_notes_scan(spark, sf):
    bad = table(spark, sf, "labels").where("toxic = 1").select(
        F.col("doc_id").alias("performance_id"))
    n = C.select_notes(notes(spark, sf), labels=["match", "insertion"], bad=bad)
    return n.select("performance_id", "note_id", F.col("event_type").alias("piece_id"), "pitch",
                    "label")


@query("aligned_fact_rows", sql("notes", """
SELECT performance_id, note_id AS pair_id, label,
  CASE WHEN label <> 'insertion' THEN note_id END AS s_id, CASE WHEN label <> 'deletion' THEN note_id END AS p_id,
  CASE WHEN label <> 'insertion' THEN pitch END AS s_pitch, CASE WHEN label <> 'insertion' THEN k END AS s_pos,
  CASE WHEN label <> 'deletion' THEN velocity END AS p_velocity,
  CASE WHEN label <> 'deletion' THEN onset_us END AS p_onset_us FROM notes"""))
def aligned_fact_rows(spark, sf):
    n = notes(spark, sf)
    pairs = n.select("performance_id", F.col("note_id").alias("pair_id"), "label",
                     F.when(F.col("label") != "insertion", F.col("note_id")).alias("s_id"),
                     F.when(F.col("label") != "deletion", F.col("note_id")).alias("p_id"))
    s = n.where("label <> 'insertion'").select("performance_id", F.col("note_id").alias("s_id"),
                                               "pitch", F.col("k").alias("pos"))
    p = n.where("label <> 'deletion'").select("performance_id", F.col("note_id").alias("p_id"),
                                              "velocity", "onset_us")
    return C.aligned_notes(pairs, s, p, P)


@query("performance_records", sql("notes", """
SELECT performance_id, count(*) FILTER (label = 'match') AS n_match,
  count(*) FILTER (label = 'interpolated') AS n_interpolated, count(*) FILTER (label = 'insertion') AS n_insertion,
  count(*) FILTER (label = 'deletion') AS n_deletion, count(*) FILTER (label <> 'insertion') AS n_score_notes,
  count(*) FILTER (label <> 'deletion') AS n_perf_notes,
  round((max(onset_us + duration_us) FILTER (label <> 'deletion') - min(onset_us) FILTER (label <> 'deletion'))
    / 1e6, 6) AS duration_sec FROM notes GROUP BY 1"""))
def performance_records(spark, sf):
    return rnd(C.performance_record(notes(spark, sf), P), 6, "duration_sec")


@query("piece_manifest", """
WITH perf AS (SELECT o_orderkey AS performance_id, o_custkey AS piece_id, o_orderstatus FROM orders),
pc AS (SELECT piece_id, count(*) AS n_performances FROM perf GROUP BY 1)
SELECT pc.piece_id, n_performances - coalesce(b, 0) AS n_performances FROM pc
LEFT JOIN (SELECT piece_id, count(*) AS b FROM perf WHERE o_orderstatus = 'P' GROUP BY 1) x USING (piece_id)
WHERE n_performances - coalesce(b, 0) > 0""")
def piece_manifest(spark, sf):
    perf = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("performance_id"), F.col("o_custkey").alias("piece_id"),
        "o_orderstatus")
    pieces = perf.groupBy("piece_id").agg(F.count("*").alias("n_performances"))
    return C.load_pieces(pieces, perf, perf.where("o_orderstatus = 'P'").select("performance_id"))


def _meta(spark, sf):
    t = takes(spark, sf)
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("performer_id"),
                                            F.col("c_nationkey").cast("bigint").alias("piece_id"))
    return t.join(c, "performer_id").select(
        "performance_id", "performer_id", "piece_id", "year",
        (F.col("tier") <= 4).alias("tier_b"), (F.col("tier") <= 3).alias("tier_a"),
        (F.col("tier") == 1).alias("tier_a_star"), (F.col("status") == "O").alias("sensor"),
        (F.col("performance_id") % 17).alias("score_id"),
        F.when(F.col("year") >= 1998, "test").otherwise("train").alias("split"))


META = """, c AS (SELECT c_custkey AS performer_id, CAST(c_nationkey AS BIGINT) AS piece_id FROM customer),
meta AS (SELECT performance_id, performer_id, piece_id, year, tier <= 4 AS tier_b, tier <= 3 AS tier_a,
  tier = 1 AS tier_a_star, status = 'O' AS sensor, performance_id % 17 AS score_id,
  CASE WHEN year >= 1998 THEN 'test' ELSE 'train' END AS split FROM takes JOIN c USING (performer_id))"""


@query("metadata_tier", sql("takes", META + """
SELECT performance_id, piece_id, split FROM meta WHERE tier_a AND split = 'train'
  AND performance_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"""))
def metadata_tier(spark, sf):
    bad = table(spark, sf, "labels").where("toxic = 1").select(
        F.col("doc_id").alias("performance_id"))
    m = C.select_tier(_meta(spark, sf), "a", split="train", bad=bad)
    return m.select("performance_id", "piece_id", "split")


@query("piece_counts", sql("takes", META + """
SELECT piece_id, count(*) AS n_c, count(*) FILTER (tier_b) AS n_b, count(*) FILTER (tier_a) AS n_a,
  count(*) FILTER (tier_a_star) AS n_a_star, count(*) FILTER (tier_a AND sensor) AS n_a_sensor,
  count(DISTINCT performer_id) FILTER (tier_a) AS n_a_performers,
  count(DISTINCT score_id) FILTER (tier_a) AS n_scores_a FROM meta GROUP BY 1"""))
def piece_counts(spark, sf):
    return C.piece_counts(_meta(spark, sf), ["piece_id"]).orderBy(
        F.desc("n_a"), F.desc("n_a_star"), F.desc("n_c"))


@query("datasets_by_piece", """
SELECT lang || '_' || (n_chars % 50) AS piece_id, array_to_string(list_sort(list(DISTINCT source)), ' ') AS datasets
FROM documents WHERE n_chars > 100 GROUP BY 1""")
def datasets_by_piece(spark, sf):
    d = table(spark, sf, "documents").select(
        F.concat_ws("_", "lang", (F.col("n_chars") % 50).cast("string")).alias("piece_id"),
        F.col("source").alias("dataset"), (F.col("n_chars") > 100).alias("canonical"))
    return C.datasets_by_piece(d).withColumn("datasets", F.concat_ws(" ", "datasets"))


@query("crosswalk_union", """
SELECT dataset, piece_id, CAST(sum(n) AS BIGINT) AS n_performances FROM (
  SELECT 'docs' AS dataset, lang AS piece_id, count(*) AS n FROM documents GROUP BY 2
  UNION ALL SELECT 'pages', substr(split_part(url, '/', 4), 1, 2), count(*) FROM pages GROUP BY 2
  UNION ALL SELECT 'chat', role, count(*) FROM conversations GROUP BY 2) GROUP BY 1, 2""")
def crosswalk_union(spark, sf):
    return T.crosswalk({
        "docs": (table(spark, sf, "documents"), F.col("lang")),
        "pages": (table(spark, sf, "pages"), F.substring(F.split("url", "/")[3], 1, 2)),
        "chat": (table(spark, sf, "conversations"), F.col("role"))})


@query("corpus_counters", sql("notes", """
, s AS (SELECT performance_id, note_id FROM notes WHERE label <> 'insertion' AND k < 95),
p AS (SELECT performance_id, note_id FROM notes WHERE label <> 'deletion' AND k >= 5)
SELECT count(DISTINCT n.performance_id) AS n_performances, count(*) FILTER (label = 'match') AS n_match,
  count(*) FILTER (label = 'insertion') AS n_insertion, count(*) FILTER (label = 'deletion') AS n_deletion,
  count(*) FILTER (label <> 'insertion' AND k >= 95) AS n_unknown_score_ids,
  count(*) FILTER (label <> 'deletion' AND k < 5) AS n_unknown_performance_ids,
  0::BIGINT AS n_unreferenced_score, 0::BIGINT AS n_unreferenced_played FROM notes n"""))
def corpus_counters(spark, sf):
    n = notes(spark, sf)
    pairs = n.select("performance_id", "label",
                     F.when(F.col("label") != "insertion", F.col("note_id")).alias("s_id"),
                     F.when(F.col("label") != "deletion", F.col("note_id")).alias("p_id"))
    s = n.where("label <> 'insertion' and k < 95").select("performance_id", F.col(
        "note_id").alias("s_id"))
    p = n.where("label <> 'deletion' and k >= 5").select("performance_id", F.col(
        "note_id").alias("p_id"))
    return C.corpus_counters(pairs, s, p)


@query("ratings_from_wide", """
WITH w AS (SELECT DISTINCT l_orderkey AS rater, l_linenumber AS item, l_quantity AS q1,
    l_discount * 100 AS q2, l_tax * 100 AS q3 FROM lineitem
  WHERE NOT (l_quantity > 45 OR l_discount * 100 > 45 OR l_tax * 100 > 45))
SELECT rater, CAST(item AS BIGINT) AS item, dimension, round(value, 6) AS value FROM
  (UNPIVOT w ON q1, q2, q3 INTO NAME dimension VALUE value) WHERE value <> 0""")
def ratings_from_wide(spark, sf):
    w = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("rater"), F.col("l_linenumber").cast("bigint").alias("item"),
        F.col("l_quantity").alias("q1"), (F.col("l_discount") * 100).alias("q2"),
        (F.col("l_tax") * 100).alias("q3"))
    return rnd(R.ratings_from_wide(w, ["rater", "item"], ["q1", "q2", "q3"], 45), 6, "value")


@query("beat_curves_wide_to_long", sql("notes", """
SELECT performance_id, dimension AS recording, value FROM (UNPIVOT (SELECT performance_id,
    round(max(value) FILTER (event_type = 'view'), 6) AS a_view, round(max(value) FILTER (event_type = 'click'), 6) AS b_click,
    round(max(value) FILTER (event_type = 'error' AND k < 50), 6) AS c_error FROM notes GROUP BY 1)
  ON a_view, b_click, c_error INTO NAME dimension VALUE value)"""))
def beat_curves_wide_to_long(spark, sf):
    n = notes(spark, sf)

    def cell(t, extra=None):
        c = F.col("event_type") == t
        return F.round(F.max(F.when(c if extra is None else c & extra, F.col("value"))), 6)

    w = n.groupBy("performance_id").agg(
        cell("view").alias("a_view"), cell("click").alias("b_click"),
        cell("error", F.col("k") < 50).alias("c_error"))
    return R.wide_to_long(w, P, ["a_view", "b_click", "c_error"], "recording", "value")


@query("curve_completeness", sql("notes", """
SELECT performance_id, count(*) AS n_beats, count(*) = count(DISTINCT k) AS complete FROM notes GROUP BY 1"""))
def curve_completeness(spark, sf):
    return T.curve_completeness(notes(spark, sf), P, "k")


@query("page_name_parts", """
SELECT page_id, split_part(url, '/', 3) AS work, CAST(page_id % 9 + 1 AS INTEGER) AS bars,
  CAST(length(url) AS INTEGER) AS segment, CAST(length(html) AS INTEGER) AS player FROM pages
WHERE split_part(url, '/', 3) <> ''""")
def page_name_parts(spark, sf):
    name = F.concat(F.split_part("url", F.lit("/"), F.lit(3)), F.lit("_"), F.col("page_id") % 9 + 1,
                    F.lit("bars_"), F.length("url"), F.lit("_"), F.length("html"), F.lit(".mid"))
    parts = table(spark, sf, "pages").select("page_id", R.parse_segment_name(name).alias("p"))
    return parts.where("p is not null").select("page_id", "p.*")


@query("first_question_text", """
SELECT conv_id, role, arg_min(text, (turn, text)) AS question, count(*) AS n FROM conversations GROUP BY 1, 2""")
def first_question_text(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id", "role").agg(
        F.min_by("text", F.struct("turn", "text")).alias("question"), F.count("*").alias("n"))


@query("sectioned_lists", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
  CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS pos FROM documents),
h AS (SELECT *, CASE WHEN length(line) <= 40 THEN line END AS head FROM l),
f AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM h)
SELECT doc_id, pos, md5(line) AS line_md5, section FROM f WHERE head IS NULL""")
def sectioned_lists(spark, sf):
    from ritardo.operators.ordered import chunk_of

    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias(
        "pos", "line"))
    d = d.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "line",
                 F.when(F.length("line") <= 40, F.col("line")).alias("head"))
    d = scan(d, ["doc_id"], ["pos"], chunk_of("pos", 1024), section=("last", "head"))
    return d.where("head is null").select("doc_id", "pos", F.md5("line").alias("line_md5"),
                                          "section")


@query("label_strings", sql("score", """
SELECT DISTINCT score_id, v AS label FROM (
  SELECT score_id, unnest([voice, status, CASE WHEN quantity > 25 THEN quantity || '/50' END]) AS v FROM score)
WHERE v IS NOT NULL AND v <> 'N'"""))
def label_strings(spark, sf):
    s = score(spark, sf).select(
        "score_id", "voice", "status",
        F.when(F.col("quantity") > 25, F.concat(F.col("quantity").cast("string"), F.lit(
            "/50"))).alias("frac"))
    long = R.wide_to_long(s, ["score_id"], ["voice", "status", "frac"], "facet", "label")
    return long.where("label <> 'N'").select("score_id", "label").distinct()


@query("fraction_positions", sql("score", """
SELECT score_id, note_id, round(quantity / (quantity % 7 + 1), 9) AS pos FROM score"""))
def fraction_positions(spark, sf):
    s = score(spark, sf)
    f = F.concat_ws("/", F.col("quantity").cast("string"), (F.col("quantity") % 7 + 1).cast(
        "string"))
    return s.select("score_id", "note_id", F.round(R.fraction(f), 9).alias("pos"))


@query("beat_alignment_rows", sql("notes", """
SELECT performance_id, note_id, k AS bar, round((k % 4) / 4.0, 9) AS beat_frac, round(value, 6) AS time_sec
FROM notes"""))
def beat_alignment_rows(spark, sf):
    n = notes(spark, sf)
    line = F.concat(F.col("k").cast("string"), F.lit("+"), (F.col("k") % 4).cast("string"),
                    F.lit("/4 "), F.format_string("%.6f", "value"))
    out = R.beat_alignment(n.select("performance_id", "note_id", line.alias("line")), "line")
    return rnd(out, 9, "beat_frac").withColumn("time_sec", F.round("time_sec", 6))


@query("hand_label_summary", sql("score", """
SELECT score_id, count(*) FILTER (staff = 1 AND voice <> 'N') AS n_right,
  count(*) FILTER (staff = 2 AND voice <> 'N') AS n_left, count(*) FILTER (voice = 'N') AS n_none,
  count(DISTINCT order_id) AS n_candidates FROM score GROUP BY 1"""))
def hand_label_summary(spark, sf):
    return T.hand_label_summary(score(spark, sf), ["score_id"], F.col("staff"), F.col("voice") != "N",
                                "order_id")


@query("labels_to_pairs", sql("notes", """
, l AS (SELECT performance_id, note_id, CASE event_type WHEN 'view' THEN 'wrong_pitch' WHEN 'error' THEN 'missed'
  WHEN 'signup' THEN 'extra' ELSE 'correct' END AS label FROM notes)
SELECT performance_id, 'deletion' AS pair_label, note_id AS s_id, NULL::BIGINT AS p_id FROM l WHERE label IN ('wrong_pitch', 'missed')
UNION ALL SELECT performance_id, 'insertion', NULL, note_id FROM l WHERE label IN ('wrong_pitch', 'extra')
UNION ALL SELECT performance_id, 'match', note_id, note_id FROM l WHERE label = 'correct'"""))
def labels_to_pairs(spark, sf):
    n = notes(spark, sf)
    lab = (F.when(F.col("event_type") == "view", "wrong_pitch")
           .when(F.col("event_type") == "error", "missed")
           .when(F.col("event_type") == "signup", "extra").otherwise("correct"))
    return C.label_pairs(n.select("performance_id", lab.alias("label"), F.col("note_id").alias(
        "s_id"), F.col("note_id").alias("p_id")))


@query("training_items", sql("notes", """
, m AS (SELECT *, onset_us // 10000000 AS part FROM notes WHERE label = 'match'),
n AS (SELECT performance_id, count(*) AS n_notes FROM m GROUP BY 1 HAVING count(*) >= 25)
SELECT performance_id, n_notes, part, array_to_string(list(pitch ORDER BY onset_us, note_id), ',') AS pitch,
  array_to_string(list(velocity ORDER BY onset_us, note_id), ',') AS velocity
FROM m JOIN n USING (performance_id) GROUP BY 1, 2, 3"""))
def training_items(spark, sf):
    n = notes(spark, sf).where("label = 'match'")
    t = C.training_items(n, P, ["pitch", "velocity"], ["onset_us", "note_id"],
                         F.expr("onset_us div 10000000"), min_notes=25)
    return t.withColumns({c: F.concat_ws(",", F.col(c).cast("array<string>"))
                          for c in ("pitch", "velocity")})


@query("json_reports", sql("notes", """
, r AS (SELECT performance_id, count(*) AS n, round(avg(velocity), 3) AS v,
  CASE WHEN count(*) > 70 THEN NULL ELSE round(max(value), 2) END AS m FROM notes GROUP BY 1)
SELECT performance_id, n AS n_read, v AS v_read, m AS m_read, m IS NULL AS m_null FROM r"""))
def json_reports(spark, sf):
    r = notes(spark, sf).groupBy("performance_id").agg(
        F.count("*").alias("n"), F.round(F.avg("velocity"), 3).alias("v"),
        F.when(F.count("*") > 70, F.lit(float("nan"))).otherwise(F.round(F.max("value"), 2)).alias(
            "m"))
    j = R.json_report(r, P)

    def field(name, kind):
        return F.get_json_object("report", f"$.{name}").cast(kind)

    return j.select("performance_id", field("n", "bigint").alias("n_read"),
                    field("v", "double").alias("v_read"), field("m", "double").alias("m_read"),
                    F.col("report").contains('"m":null').alias("m_null"))


@query("span_extents", sql("score", """
SELECT score_id, order_id AS span_id, min_by(note_id, (onset_uq, note_id)) AS first_note,
  max_by(note_id, (onset_uq, note_id)) AS last_note, min(onset_uq) AS start_uq, max(onset_uq) AS end_uq
FROM score GROUP BY 1, 2"""))
def span_extents(spark, sf):
    o = F.struct("onset_uq", "note_id")
    return score(spark, sf).groupBy("score_id", F.col("order_id").alias("span_id")).agg(
        F.min_by("note_id", o).alias("first_note"), F.max_by("note_id", o).alias("last_note"),
        F.min("onset_uq").alias("start_uq"), F.max("onset_uq").alias("end_uq"))


# ------------------------------------------------------------------ quality gates

def _guarded(spark, sf):
    t = takes(spark, sf)
    idx = t.select(
        "performance_id", F.col("performer_id").alias("piece_id"),
        (F.col("performer_id") % 97).alias("score_path"),
        (F.col("price") / 1000).alias("note_count"), F.lit(200.0).alias("score_note_count"),
        (F.col("price") / 700).alias("duration"), (F.col("tier") * 100.0).alias("refined_duration"))
    sn = table(spark, sf, "supplier").groupBy((F.col("s_suppkey") % 90).alias("score_path")).agg(
        F.max("s_acctbal").alias("b")).select("score_path", (F.col("b") / 30).alias(
            "unfolded_max"))
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("piece_id"),
                                               "c_nationkey", "c_mktsegment")
    bad = table(spark, sf, "labels").where("toxic = 1").select(
        F.col("doc_id").alias("performance_id"))
    return Q.raw_guard(idx, sn, cust.where("c_nationkey = 3"), bad,
                       cust.where("c_mktsegment = 'BUILDING'"), cust.where("c_nationkey = 5"))


GUARD = """, sn AS (SELECT s_suppkey % 90 AS score_path, max(s_acctbal) / 30 AS u FROM supplier GROUP BY 1 HAVING max(s_acctbal) / 30 > 0),
gx AS (SELECT t.performance_id, t.price / 1000 AS nc, t.price / 700 AS du, t.tier * 100.0 AS rd,
  coalesce(sn.u, 200.0) AS den, c.c_nationkey AS nk, c.c_mktsegment AS seg, l.doc_id AS ml
  FROM takes t LEFT JOIN sn ON sn.score_path = t.performer_id % 97
  LEFT JOIN customer c ON c.c_custkey = t.performer_id
  LEFT JOIN labels l ON l.doc_id = t.performance_id AND l.toxic = 1),
gd AS (SELECT performance_id, CASE WHEN nk = 3 THEN 'score version mismatch' WHEN ml IS NOT NULL THEN 'mislabelled row'
  WHEN nk IS DISTINCT FROM 5 AND den > 0 AND nc > 1.65 * den THEN 'more notes than the score'
  WHEN seg = 'BUILDING' AND du > 1.3 * rd THEN 'longer than the refined recording' ELSE '' END AS reason FROM gx)"""


@query("raw_guard", sql("takes", GUARD + " SELECT performance_id, reason FROM gd"))
def raw_guard(spark, sf):
    return _guarded(spark, sf).select("performance_id", "reason")


@query("guard_jobs", sql("takes", GUARD + """
SELECT o.l_orderkey AS performance_id, count(*) AS n_jobs FROM lineitem o
WHERE o.l_orderkey NOT IN (SELECT performance_id FROM gd WHERE reason <> '') GROUP BY 1"""))
def guard_jobs(spark, sf):
    jobs = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("performance_id"))
    return Q.guard_jobs(jobs, _guarded(spark, sf)).groupBy("performance_id").agg(
        F.count("*").alias("n_jobs"))


@query("take_gap_ratio", sql("notes", """
, d AS (SELECT performance_id, note_id - lag(note_id) OVER w AS ds, onset_us - lag(onset_us) OVER w AS dp
  FROM notes WINDOW w AS (PARTITION BY performance_id ORDER BY note_id)),
r AS (SELECT performance_id, dp / ds AS rate FROM d WHERE ds > 0),
a AS (SELECT performance_id, count(*) AS n, median(rate) AS med, max(rate) AS top FROM r GROUP BY 1),
m AS (SELECT performance_id, avg((label = 'match')::INT) AS em, avg((label <> 'deletion')::INT) AS nm,
  avg((label = 'insertion')::INT) AS ins FROM notes GROUP BY 1)
SELECT performance_id, round(top / med, 6) AS max_gap_ratio,
  em >= 0.9 AND nm >= 0.9 AND ins <= 0.15 AND top / med <= 8 AS accepted FROM a JOIN m USING (performance_id)"""))
def take_gap_ratio(spark, sf):
    n = notes(spark, sf)
    g = Q.max_gap_ratio(n, P, "note_id", "onset_us", 4096)

    def share(c):
        return F.avg(c.cast("int"))

    m = n.groupBy("performance_id").agg(
        share(F.col("label") == "match").alias("em"), share(F.col("label") != "deletion").alias(
            "nm"), share(F.col("label") == "insertion").alias("ins"))
    j = g.join(m, "performance_id")
    return j.select("performance_id", F.round("max_gap_ratio", 6).alias("max_gap_ratio"),
                    Q.take_accepted(F.col("em"), F.col("nm"), F.col("ins"), F.col(
                        "max_gap_ratio")).alias("accepted"))


def _edges(spark, sf):
    n = notes(spark, sf).withColumn("measure_idx", F.expr("onset_us div 2000000"))
    b = n.groupBy("performance_id", "measure_idx").agg(
        F.count(F.when(F.col("label") != "insertion", 1)).alias("n_notes"))
    cut = n.groupBy("performance_id").agg(
        (F.min("k") % 2 == 0).alias("cut_start"), (F.max("k") % 2 == 1).alias("cut_end"))
    return n, Q.edge_bars(b.join(cut, "performance_id"), P, 2)


EDGES = """, nb AS (SELECT *, onset_us // 2000000 AS measure_idx FROM notes),
b AS (SELECT performance_id, measure_idx FROM nb GROUP BY 1, 2 HAVING count(*) FILTER (label <> 'insertion') > 0),
cut AS (SELECT performance_id, min(k) % 2 = 0 AS cs, max(k) % 2 = 1 AS ce FROM nb GROUP BY 1),
rk AS (SELECT b.*, cs, ce, row_number() OVER (PARTITION BY b.performance_id ORDER BY measure_idx) AS r,
  row_number() OVER (PARTITION BY b.performance_id ORDER BY measure_idx DESC) AS rd FROM b JOIN cut USING (performance_id)),
ed AS (SELECT performance_id, measure_idx, cs AND r <= 2 AS at_start, ce AND rd <= 2 AS at_end FROM rk
  WHERE (cs AND r <= 2) OR (ce AND rd <= 2))"""


@query("edge_bars", sql("notes", EDGES + """
SELECT performance_id, measure_idx, at_start, at_end FROM ed"""))
def edge_bars(spark, sf):
    return _edges(spark, sf)[1].select("performance_id", "measure_idx", "at_start", "at_end")


@query("edge_outside_notes", sql("notes", EDGES + """
, j AS (SELECT nb.*, at_start, at_end, label = 'match' AS matched FROM nb JOIN ed USING (performance_id, measure_idx)
  WHERE label <> 'insertion'),
l AS (SELECT performance_id, measure_idx, min(onset_us) FILTER (matched) AS lo, max(onset_us) FILTER (matched) AS hi
  FROM j GROUP BY 1, 2)
SELECT performance_id, note_id FROM j JOIN l USING (performance_id, measure_idx)
WHERE lo IS NULL OR (at_start AND onset_us < lo) OR (at_end AND onset_us > hi)"""))
def edge_outside_notes(spark, sf):
    n, e = _edges(spark, sf)
    s = n.where("label <> 'insertion'").select(
        "performance_id", "note_id", "measure_idx", F.col("onset_us").alias("pos"),
        (F.col("label") == "match").alias("matched"))
    return Q.edge_outside(s, e, P).select("performance_id", "note_id")


@query("gate_counts", sql("takes", """
SELECT count(*) FILTER (NOT price > 100000) AS dropped_price, count(*) FILTER (NOT tier <= 3) AS dropped_tier,
  count(*) FILTER (NOT year >= 1995) AS dropped_year,
  count(*) FILTER (price > 100000 AND tier <= 3 AND year >= 1995) AS kept, count(*) AS total FROM takes"""))
def gate_counts(spark, sf):
    return Q.gate_counts(takes(spark, sf), {
        "price": F.col("price") > 100000, "tier": F.col("tier") <= 3,
        "year": F.col("year") >= 1995})




@query("listing_index", """
WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([a-z0-9.-]+)/([a-z0-9-]+)/?(.*)$', ['host', 'section', 'leaf']) AS x FROM pages
  WHERE regexp_matches(url, '^https?://([a-z0-9.-]+)/([a-z0-9-]+)/?(.*)$')),
l AS (SELECT regexp_extract(url, '^https?://([a-z0-9.-]+)/', 1) AS host, min(page_id) % 3 AS split FROM pages WHERE page_id % 4 <> 0 GROUP BY 1)
SELECT page_id, x.host AS host, x.section AS section, lower(x.host || '_' || x.section || '_' || x.leaf) AS item_id, split
FROM p LEFT JOIN l ON l.host = x.host""")
def listing_index(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    split = pages.where("page_id % 4 <> 0").groupBy(F.regexp_extract(
        "url", r"^https?://([a-z0-9.-]+)/", 1).alias("host")).agg((F.min("page_id") % 3).alias("split"))
    d = C.listing_index(pages, "url", r"^https?://([a-z0-9.-]+)/([a-z0-9-]+)/?(.*)$",
                        ["host", "section", "leaf"], ["host", "section", "leaf"], lookup=split, on=["host"])
    return d.select("page_id", "host", "section", "item_id", "split")

"""Further registered queries over the test tables: sources, checks, findings, reports and runs, with SQL that computes the same rows.

Where an operator needs rows that no table has as such, they are made of a table's own columns, and the SQL makes them the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import checks, glossary, layout, pages, paragraphs, performance, quality, repeated, reports, translate
from quire.plans.options import TranslationOptions
from quire.queries import _FINDINGS, _NORMALIZED, _PARAGRAPHS, _REPEATED, _SOFT, _SOURCE, _SPACES, _UNITS, SQL, _furniture, _samples, _stored_furniture, _units, query
from quire.sources import adapters, datasets, files
from quire.sources.tables import read_table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "labels")


def _long(c: Column) -> Column:
    return c.cast("long")


# Text

@query(f"SELECT doc_id, length({_SOURCE}) AS chars, strlen({_SOURCE})::BIGINT AS bytes, sha256({_NORMALIZED}) AS hash FROM documents")
def source_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with ligatures expanded and characters composed: their lengths, and the hash of the normalized text."""
    source = T.source_text(F.col("text"))
    return _documents(spark, sf_dir).select("doc_id", _long(F.length(source)).alias("chars"), _long(F.octet_length(source)).alias("bytes"), F.sha2(T.normalize(F.col("text")), 256).alias("hash"))


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS n_lines, count(DISTINCT trim(regexp_replace(replace(lower(line), 'ß', 'ss'), '\s+', ' ', 'g'))) AS n_folded FROM l GROUP BY doc_id""")
def folded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document, and how many differ without regard to case and white space."""
    lines = _documents(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_distinct(T.collapse(F.col("line"))).alias("n_folded"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[\x{FFFD}\x{FDD0}-\x{FDEF}\x{FFFE}\x{FFFF}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]'))::BIGINT AS n_suspicious,
  regexp_matches(text, '[\x{E000}-\x{F8FF}]') AND NOT regexp_matches(text, '\pL') AS marker, regexp_matches(text, '[\x{0400}-\x{052F}]') AS cyrillic FROM documents""")
def suspicious_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replacement, control and noncharacters of each document, whether it is private-use marks alone, and whether it has Cyrillic letters."""
    c = F.col("text")
    return _documents(spark, sf_dir).select("doc_id", _long(F.size(T.suspicious(c))).alias("n_suspicious"), T.private_marker(c).alias("marker"), checks.has_cyrillic(c).alias("cyrillic"))


@query("SELECT source, string_agg(DISTINCT c, '' ORDER BY c) AS characters, count(DISTINCT c) AS n FROM (SELECT source, unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY source")
def font_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The characters that a font for the documents of each source must have."""
    found = checks.code_points(_documents(spark, sf_dir), "text", "source")
    return found.select("source", F.array_join("characters", "").alias("characters"), _long(F.size("characters")).alias("n"))


_LOST = lambda pattern: f"list_filter(list_distinct(regexp_extract_all(source, '{pattern}')), lambda x: len(list_filter(regexp_extract_all(source, '{pattern}'), lambda y: y = x)) > len(list_filter(regexp_extract_all(output, '{pattern}'), lambda y: y = x)))"


@query(f"""WITH s AS (SELECT doc_id, text AS source, CASE WHEN doc_id % 7 = 0 THEN left(text, 10) WHEN doc_id % 2 = 1 THEN regexp_replace(text, '[0-9]', '', 'g') ELSE 'RU ' || text END AS output FROM documents)
SELECT doc_id, array_to_string(list_sort({_LOST(T.URL)}), ' ') AS urls, array_to_string(list_sort({_LOST(T.EMAIL)}), ' ') AS emails, array_to_string(list_sort({_LOST(T.DRIVE_PATH)}), ' ') AS paths FROM s""")
def values_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, addresses and paths that an output has fewer times than its source."""
    lost = T.missing_values(F.col("source"), F.col("output"), (T.URL, T.EMAIL, T.DRIVE_PATH))
    rows = _samples(spark, sf_dir).select(F.col("sample_id").alias("doc_id"), lost.alias("l"))
    return rows.select("doc_id", *[F.array_join(F.array_sort(F.array_distinct(F.get("l", F.lit(k)))), " ").alias(c) for k, c in enumerate(("urls", "emails", "paths"))])


@query(r"""WITH p AS (SELECT doc_id, text, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS words, list_filter(string_split(regexp_replace(text, '\n(?:[ \t]*\n)+', chr(1), 'g'), chr(1)), lambda x: true) AS paragraphs FROM documents),
u AS (SELECT doc_id, words, list_transform(paragraphs, lambda p: list_transform(list_filter(string_split(regexp_replace(trim(p, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> ''), lambda s: len(list_filter(regexp_split_to_array(s, '\s+'), lambda w: w <> '')))) AS sentences FROM p),
f AS (SELECT doc_id, words, sentences, list_sum(list_transform(sentences, lambda l: list_reduce(list_prepend({'n': 0::BIGINT, 'at': 0::BIGINT, 'w': 0::BIGINT}, list_transform(l, lambda w: {'n': 0::BIGINT, 'at': 0::BIGINT, 'w': w::BIGINT})),
  lambda a, x: {'n': a.n + CASE WHEN x.w > 62 THEN (a.at > 0)::BIGINT + ceil(x.w / 62.0)::BIGINT WHEN a.at > 0 AND a.at + x.w > 62 THEN 1 ELSE 0 END, 'at': CASE WHEN x.w > 62 THEN 0 WHEN a.at + x.w <= 62 THEN a.at + x.w ELSE x.w END, 'w': 0::BIGINT}))
  .apply(lambda r: r.n + (r.at > 0)::BIGINT)) AS n FROM u)
SELECT doc_id, CASE WHEN words <= 62 THEN 1 ELSE n END::BIGINT AS n_segments, words > 62 AND len(list_filter(flatten(sentences), lambda w: w > 62)) > 0 AS forced FROM f""")
def segment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many segments of at most 64 tokens each document is packed into, and whether a sentence had to be cut."""
    rows = _documents(spark, sf_dir).select("doc_id", T.segment(F.col("text"), 64).alias("s"))
    return rows.select("doc_id", _long(F.size("s.segments")).alias("n_segments"), F.col("s.forced").alias("forced"))


@query("""WITH s AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n FROM documents)
SELECT doc_id, CASE WHEN n < 1024 THEN n || '.00 B' WHEN n < 1048576 THEN printf('%.2f KiB', n / 1024.0::DOUBLE) ELSE printf('%.2f MiB', n / 1048576.0::DOUBLE) END AS shown, round((n >> 16 & 255) / 255.0::DOUBLE, 6) AS r, round((n >> 8 & 255) / 255.0::DOUBLE, 6) AS g, round((n & 255) / 255.0::DOUBLE, 6) AS b FROM s""")
def sizes_and_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's size in binary units, and the size as a packed colour."""
    n = F.octet_length(F.coalesce("text", F.lit("")).cast("binary"))
    rows = _documents(spark, sf_dir).select("doc_id", T.human_bytes(n).alias("shown"), T.unpack_rgb(n).alias("c"))
    return rows.select("doc_id", "shown", *[F.round(f"c.{x}", 6).alias(x) for x in ("r", "g", "b")])


@query("SELECT doc_id, CASE WHEN length(text) <= 240 THEN text ELSE left(text, 240) || '...' END AS snippet, array_to_string((list_filter(string_split(text, ' '), lambda w: w <> ''))[1:8], ', ') AS first_words FROM documents")
def shortened_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a message shows of each document: its beginning, and its first eight words."""
    words = F.filter(F.split("text", " "), lambda w: w != "")
    return _documents(spark, sf_dir).select("doc_id", checks.snippet(F.col("text")).alias("snippet"), checks.shown(words).alias("first_words"))


# Files and manifests: the address of a page, without its scheme, as a path

_PATHS = """paths AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') || CASE page_id % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.ru.pdf' WHEN 2 THEN '.txt' ELSE '.pdf' END AS path FROM pages)"""


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id") % 5
    end = F.when(n == 0, ".PDF").when(n == 1, ".ru.pdf").when(n == 2, ".txt").otherwise(".pdf")
    return read_table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace("url", "^[a-z]+://", ""), end).alias("path"))


@query(rf"""WITH {_PATHS}
SELECT path, CASE WHEN starts_with(path, 'www.example.com/') THEN 'inside_output' WHEN regexp_matches(path, '(?i)\.ru\.pdf$') THEN 'already_translated' WHEN NOT regexp_matches(path, '(?i)\.pdf$') THEN 'not_a_pdf'
  WHEN NOT (regexp_matches(path, '[0-9]') OR contains(lower(path), 'example')) THEN 'not_included' WHEN contains(path, '7') THEN 'excluded' END AS skip FROM paths""")
def discovered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a file isn't taken, if it isn't: by folder, kind and patterns."""
    return files.skip_reasons(_paths(spark, sf_dir).select("path"), ("*[0-9]*", "*example*"), ("*7*",), "www.example.com")


@query(rf"""WITH {_PATHS}
SELECT page_id, regexp_replace(path, '(?i)\.pdf$', '.ru.pdf') AS output, regexp_replace(path, '\.[^./]*$', '') || '.debug.pdf' AS debug, regexp_replace(path, '\.[^./]*$', '') || '.failed-render.pdf' AS failed, 'document-' || left(sha256(lower(path)), 12) AS id FROM paths""")
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names beside each file, and the id of a document that no manifest names."""
    p = F.col("path")
    return _paths(spark, sf_dir).select("page_id", files.output_name(p).alias("output"), files.named_output(p, "debug").alias("debug"), files.named_output(p, "failed").alias("failed"), files.generated_id(p).alias("id"))


_MANIFEST = """m AS (SELECT 'D' || (page_id % 200) AS document_id, CASE page_id % 11 WHEN 0 THEN '/' || path WHEN 1 THEN 'a/../' || path WHEN 2 THEN 'C:' || path ELSE path END AS path FROM paths), there AS (SELECT path FROM paths WHERE page_id % 3 <> 0)"""


@query(rf"""WITH {_PATHS}, {_MANIFEST},
r AS (SELECT m.*, count(*) OVER (PARTITION BY lower(document_id)) > 1 AS id_again, count(*) OVER (PARTITION BY lower(path)) > 1 AS path_again FROM m),
f AS (SELECT document_id, unnest(list_filter([CASE WHEN starts_with(path, '/') OR regexp_matches(path, '^[A-Za-z]:') OR regexp_matches(path, '(^|[/\\])\.\.([/\\]|$)') OR path = '' THEN 'outside' END, CASE WHEN id_again THEN 'id repeated' END, CASE WHEN path_again THEN 'path repeated' END, CASE WHEN path NOT IN (SELECT path FROM there) THEN 'missing' END], lambda x: x IS NOT NULL)) AS problem FROM r)
SELECT document_id, problem, count(*) AS n FROM f GROUP BY document_id, problem""")
def manifest_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of a manifest of the pages: paths outside the corpus, repeated ids and paths, files that aren't there."""
    n = F.col("page_id") % 11
    paths = _paths(spark, sf_dir)
    path = F.when(n == 0, F.concat(F.lit("/"), "path")).when(n == 1, F.concat(F.lit("a/../"), "path")).when(n == 2, F.concat(F.lit("C:"), "path")).otherwise(F.col("path"))
    manifest = paths.select(F.concat(F.lit("D"), (F.col("page_id") % 200).cast("string")).alias("document_id"), path.alias("path"))
    return datasets.manifest_problems(manifest, paths.where("page_id % 3 <> 0").select("path")).groupBy("document_id", "problem").agg(F.count("*").alias("n"))


@query(rf"""WITH {_PATHS}, d AS (SELECT path, 'P' || page_id AS id, CASE WHEN page_id % 2 = 0 THEN ['even'] ELSE ['odd', 'seven'] END AS categories FROM paths)
SELECT path, CASE WHEN id = 'P7' THEN 'P7' WHEN list_contains(categories, 'even') THEN 'even' WHEN regexp_matches(lower(path), '(^|/)[^/]*\.txt$') THEN '*.txt' END AS selector FROM d""")
def subset_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first selector of a subset that fits each page: an id, a category, or a pattern of its path."""
    rows = _paths(spark, sf_dir).withColumns({"id": F.concat(F.lit("P"), "page_id"), "categories": F.when(F.col("page_id") % 2 == 0, F.array(F.lit("even"))).otherwise(F.array(F.lit("odd"), F.lit("seven")))})
    return rows.select("path", checks.in_subset(F.col("path"), F.col("id"), F.col("categories"), ("P7", "even", "*.txt", "none")).alias("selector"))


@query("""SELECT count(*) AS n_files, sum(strlen(coalesce(text, '')))::BIGINT AS bytes FROM documents""")
def folder_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of all documents as files of one folder."""
    return files.folder_size(_documents(spark, sf_dir).select(F.octet_length(F.coalesce("text", F.lit(""))).alias("file_size")))


@query("""SELECT doc_id AS path FROM (SELECT doc_id, sha256(text) AS a, sha256(CASE WHEN doc_id % 9 = 0 THEN text || '.' ELSE text END) AS b FROM documents) WHERE a <> b""")
def changed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that differ between two scans, of which the second has a dot more in every ninth."""
    scan = lambda text: _documents(spark, sf_dir).select(F.col("doc_id").alias("path"), F.octet_length(text).alias("file_size"), F.sha2(text, 256).alias("sha256"))
    return checks.changed_sources(scan(F.col("text")), scan(F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))))


@query("SELECT doc_id, nullif(trim(lang), '') AS lang, nullif(trim(CASE WHEN doc_id % 4 = 0 THEN '  ' ELSE source END), '') AS source FROM documents")
def blank_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of documents whose blank values are none; the source of every fourth is blank."""
    rows = _documents(spark, sf_dir).select("doc_id", "lang", F.when(F.col("doc_id") % 4 == 0, "  ").otherwise(F.col("source")).alias("source"))
    return files.blank_to_null(rows, "lang", "source")


@query("""SELECT user_id::VARCHAR AS cache_key, arg_max(event_type, ts) AS translated_text, max(ts) AS created_at FROM (SELECT DISTINCT ON (user_id, ts) user_id, ts, event_type FROM events ORDER BY user_id, ts, event_id) GROUP BY user_id""")
def latest_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A memory of the events, by user: the latest of each key."""
    rows = _events(spark, sf_dir).groupBy("user_id", "ts").agg(F.min_by("event_type", "event_id").alias("translated_text"))
    rows = rows.select(F.col("user_id").cast("string").alias("cache_key"), "translated_text", F.col("ts").alias("created_at"))
    return translate.merge_memory(rows.where("hash(cache_key) % 2 = 0"), rows.where("hash(cache_key) % 2 <> 0"))


# Blocks and pages

@query(r"""WITH raw AS (SELECT doc_id, page, block, line, trim(text) AS text FROM (SELECT doc_id, 1 AS page, unnest(string_split(text, chr(10))) AS text, (generate_subscripts(string_split(text, chr(10)), 1) - 1) // 3 AS block, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) WHERE trim(text) <> '')
SELECT doc_id::VARCHAR AS doc, printf('p%04d-b%04d', 1, row_number() OVER (PARTITION BY doc_id ORDER BY block)) AS block_id, (row_number() OVER (PARTITION BY doc_id ORDER BY block) - 1)::INT AS ord, string_agg(text, chr(10) ORDER BY line) AS text, min(10.0::DOUBLE * line) AS y0, max(10.0::DOUBLE * line + 9) AS y1, count(*) AS n_lines FROM raw GROUP BY doc_id, block""")
def numbered_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of three raw lines: blank lines and blocks go, the rest are numbered densely, boxes are those of their lines."""
    lines = _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc"), F.lit(1).alias("page"), F.posexplode(F.split("text", "\n", -1)).alias("k", "text"))
    y = 10.0 * (F.col("k") + 1)
    raw = lines.select("doc", "page", F.floor(F.col("k") / 3).alias("block"), F.col("k").alias("line"), "text", F.lit(0.0).alias("x0"), y.alias("y0"), F.lit(9.0).alias("x1"), (y + 9).alias("y1"))
    return files.typed_blocks(raw).select("doc", "block_id", "ord", "text", "y0", "y1", "n_lines")


@query(f"""WITH {adapters.FURNITURE_SQL}, moved AS (SELECT doc, page, ord, CASE WHEN (page + ord) % 5 = 0 THEN text || '!' ELSE text END AS text, x0, y0 + CASE WHEN (page + ord) % 7 = 0 THEN 1.0 WHEN (page + ord) % 3 = 0 THEN 0.4 ELSE 0 END AS y0, x1, y1 FROM blocks WHERE (page + ord) % 11 <> 0)
SELECT problem, count(*) AS n FROM (SELECT CASE WHEN b.doc IS NULL THEN 'not stored' WHEN a.text <> b.text THEN 'text' WHEN abs(a.y0 - b.y0) > 0.5 THEN 'box' END AS problem FROM blocks a LEFT JOIN moved b ON a.doc = b.doc AND a.page = b.page AND a.ord = b.ord) WHERE problem IS NOT NULL GROUP BY problem""")
def layout_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that differ from a stored layout, by kind of difference; boxes within half a point are equal."""
    blocks, k = _furniture(spark, sf_dir), F.col("page") + F.col("ord")
    moved = blocks.where(k % 11 != 0).withColumns({"text": F.when(k % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), "y0": F.col("y0") + F.when(k % 7 == 0, 1.0).when(k % 3 == 0, 0.4).otherwise(0.0)})
    return checks.layout_differences(blocks, moved).groupBy("problem").agg(F.count("*").alias("n"))


@query(f"""WITH {adapters.FURNITURE_SQL}, b AS (SELECT *, x1 + CASE WHEN (page + ord) % 6 = 0 THEN 60 ELSE 0 END AS right_, y1 - CASE WHEN (page + ord) % 10 = 0 THEN 40 ELSE 0 END AS low FROM blocks)
SELECT doc, count(*) AS n_sane FROM b WHERE x0 >= -0.5 AND y0 >= -0.5 AND right_ <= page_w + 0.5 AND low <= page_h + 0.5 AND right_ > x0 AND low > y0 GROUP BY doc""")
def sane_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each document whose box isn't empty and lies on its page, after some were widened or turned over."""
    k = F.col("page") + F.col("ord")
    rows = _furniture(spark, sf_dir).withColumns({"x1": F.col("x1") + F.when(k % 6 == 0, 60).otherwise(0), "y1": F.col("y1") - F.when(k % 10 == 0, 40).otherwise(0)})
    return checks.sane_boxes(rows).groupBy("doc").agg(F.count("*").alias("n_sane"))


@query(f"""WITH {adapters.FURNITURE_SQL}, f AS (SELECT doc, page, floor(x0 / 100) AS a, floor(y0 / 40) AS b, floor(x1 / 100) AS c, floor(y1 / 40) AS d, ord FROM blocks),
n AS (SELECT doc, row_number() OVER (PARTITION BY doc, page, a, b, c, d ORDER BY ord) > 1 AS repeated FROM f)
SELECT doc, count(*) FILTER (WHERE repeated) AS n_repeated, count(*) AS n FROM n GROUP BY doc""")
def repeated_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments whose box, on a coarse grid, an earlier one of the page has."""
    grid = {c: F.floor(F.col(c) / (100 if c[0] == "x" else 40)).cast("double") for c in ("x0", "y0", "x1", "y1")}
    rows = checks.first_boxes(_furniture(spark, sf_dir).withColumns(grid | {"para": F.col("ord"), "frag": F.lit(0)}))
    return rows.groupBy("doc").agg(F.count_if("repeated").alias("n_repeated"), F.count("*").alias("n"))


@query("""WITH p AS (SELECT page_id, length(html) % 30 AS chars, page_id % 3 AS n_blocks, page_id % 4 AS images, (page_id % 10) / 10.0::DOUBLE AS area FROM pages),
c AS (SELECT *, CASE WHEN n_blocks = 0 AND images = 0 THEN 'empty' WHEN images > 0 AND NOT (chars >= 20 OR n_blocks > 1) THEN 'scanned' WHEN images > 0 AND (chars >= 20 OR n_blocks > 1) AND area >= 0.15 THEN 'mixed' ELSE 'text' END AS class FROM p)
SELECT class, count(*) AS n, count(*) FILTER (WHERE class = 'scanned' AND area < 0.65) AS n_warned, sum(images)::BIGINT AS n_images, count(*) FILTER (WHERE class IN ('scanned', 'empty')) AS n_targets FROM c GROUP BY class""")
def recognition_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four classes of pages, with warnings of low image coverage, and the pages for character recognition."""
    rows = read_table(spark, sf_dir, "pages").select(F.col("url").alias("doc"), F.lit(1).alias("page"), _long(F.length("html") % 30).alias("chars"), (F.col("page_id") % 3).alias("n_blocks"), (F.col("page_id") % 4).alias("images"), ((F.col("page_id") % 10) / 10.0).alias("image_area"))
    classified = pages.classify_pages(rows)
    targets = pages.ocr_targets(classified, "on").groupBy("class").agg(F.count("*").alias("n_targets"))
    sums = classified.groupBy("class").agg(F.count("*").alias("n"), F.count("warning").alias("n_warned"), F.sum("images").alias("n_images"))
    return sums.join(targets, "class", "left").fillna(0, ["n_targets"])


@query("""WITH b AS (SELECT 'd' || (page_id % 20) AS doc, page_id AS page, 600.0::DOUBLE AS w, length(html)::BIGINT AS chars, page_id % 3 = 0 AS processed FROM pages),
a AS (SELECT doc, page, w + CASE WHEN page % 13 = 0 THEN 1 ELSE 0 END AS w, chars + CASE WHEN page % 2 = 0 THEN 50 ELSE 0 END AS chars, CASE WHEN page % 17 = 0 THEN 'scanned' ELSE 'text' END AS class, processed FROM b WHERE page % 19 <> 0),
j AS (SELECT b.doc, b.page, abs(a.w - b.w) > 0.01 AS moved, a.processed AND (a.class = 'scanned' OR a.chars - b.chars <= 0) AS poor FROM b JOIN a ON a.doc = b.doc AND a.page = b.page),
n AS (SELECT x.doc FROM (SELECT doc, count(*) AS n FROM b GROUP BY doc) x LEFT JOIN (SELECT doc, count(*) AS n FROM a GROUP BY doc) y ON x.doc = y.doc WHERE x.n IS DISTINCT FROM y.n)
SELECT doc, page::INT AS page, 'geometry' AS problem FROM j WHERE moved UNION ALL SELECT doc, page::INT, 'little text' FROM j WHERE poor UNION ALL SELECT doc, NULL, 'page count' FROM n""")
def recognition_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages before and after recognition: pages lost, another geometry, no text gained."""
    before = read_table(spark, sf_dir, "pages").select(F.concat(F.lit("d"), F.col("page_id") % 20).alias("doc"), F.col("page_id").cast("int").alias("page"), F.lit(600.0).alias("page_w"), F.lit(800.0).alias("page_h"), _long(F.length("html")).alias("chars"), F.lit("scanned").alias("class"))
    p = F.col("page")
    after = before.where(p % 19 != 0).withColumns({"page_w": F.col("page_w") + F.when(p % 13 == 0, 1.0).otherwise(0.0), "chars": F.col("chars") + F.when(p % 2 == 0, 50).otherwise(0), "class": F.when(p % 17 == 0, "scanned").otherwise("text"), "processed": p % 3 == 0})
    return pages.recognition_problems(before, after)


@query(f"""WITH {_REPEATED}, p AS (SELECT doc, page, max(kind) FILTER (WHERE kind <> 'body') AS most, min(kind) FILTER (WHERE kind <> 'body') AS least FROM labelled GROUP BY doc, page),
y AS (SELECT doc, page, list_distinct(list(CASE WHEN kind IN ('running_header', 'running_footer', 'page_number') THEN 'preserve' ELSE 'translate' END) FILTER (WHERE kind <> 'body')) AS policies FROM labelled GROUP BY doc, page)
SELECT doc, CASE WHEN coalesce(len(policies), 0) = 0 THEN 'translate' WHEN len(policies) = 1 THEN policies[1] ELSE 'preserve' END AS policy, count(*) AS n FROM y GROUP BY 1, 2""")
def page_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as paragraphs of their blocks: the policy that their classified blocks agree on, else preserve."""
    kinds = repeated.classify_repeated(_stored_furniture(spark, sf_dir))
    named = kinds.select("doc", F.concat_ws("#", "page", "block_id").alias("block_id"), F.col("page").alias("para"), "kind")
    policy = F.when(F.col("kind").isin("running_header", "running_footer", "page_number"), "preserve").otherwise("translate")
    found = translate.policies(named.select("doc", "para", "block_id"), named.where("kind <> 'body'").select("doc", "block_id", policy.alias("policy")))
    return found.groupBy("doc", "policy").agg(F.count("*").alias("n"))


# Paragraphs

@query(f"""WITH {_PARAGRAPHS}, n AS (SELECT *, sum(CASE WHEN action = 'merge' THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY page, local) AS para FROM pr),
a AS (SELECT *, min(page) OVER (PARTITION BY doc, para) AS anchor FROM n)
SELECT doc, para::BIGINT AS para, any_value(anchor) AS page, arg_min(kind, page * 100000 + local) AS kind, min(y0) FILTER (WHERE page = anchor) AS y0, max(y1) FILTER (WHERE page = anchor) AS y1, sum(n)::BIGINT AS n_fragments FROM a GROUP BY doc, para""")
def paragraph_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page, kind, box and fragments of every logical paragraph, numbered within its document."""
    made, _ = paragraphs.paragraphs_of(adapters.wrapped(read_table(spark, sf_dir, "documents")))
    return made.select("doc", _long(F.col("para")).alias("para"), "page", "kind", "y0", "y1", "n_fragments")


@query(f"""WITH {_PARAGRAPHS}, n AS (SELECT doc, page, local, action, sum(CASE WHEN action = 'merge' THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY page, local) AS para FROM pr),
i AS (SELECT n.doc, n.para, b.block_id, b.page, b.y0, trim(b.text, {_SPACES}) AS text, coalesce(b.action = 'ambiguous', false) OR coalesce(b.after = 'ambiguous', false) OR coalesce(n.action = 'ambiguous', false) AS doubt FROM pb b JOIN n ON b.doc = n.doc AND b.page = n.page AND b.local = n.local)
SELECT doc, para::BIGINT AS para, arg_min(block_id, page * 10000 + y0) AS id, bool_or(doubt) AS ambiguous, count(DISTINCT block_id) AS n_blocks,
  list_reduce(list(text ORDER BY page, y0), lambda a, x: CASE WHEN {_SOFT.format(a="a", b="x")} THEN left(a, length(a) - 1) || x ELSE a || ' ' || x END) AS text FROM i GROUP BY doc, para""")
def paragraph_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every logical paragraph: its lines joined by spaces or, where a word is cut, without its hyphen; whether a decision about it was in doubt."""
    made = paragraphs.logical_paragraphs(adapters.wrapped(read_table(spark, sf_dir, "documents"), span=paragraphs.RANGE))
    return made.select("doc", _long(F.col("para")).alias("para"), "id", "ambiguous", _long(F.size("blocks")).alias("n_blocks"), "text")


@query(rf"""WITH {adapters.wrapped_sql()}, g AS (SELECT *, lag(y1) OVER w AS py1, lag(y0) OVER w AS py0, lag(text) OVER w AS ptext FROM blocks WINDOW w AS (PARTITION BY doc, page ORDER BY ord)),
j AS (SELECT *, py1 IS NOT NULL AND (y0 - py1) >= -0.25 * greatest(least(y1 - y0, py1 - py0), 1) AND (y0 - py1) <= 0.5 * greatest(least(y1 - y0, py1 - py0), 1) AND regexp_matches(text, '^\s*\p{{Ll}}') AND rtrim(ptext, {_SPACES}) <> '' AND right(rtrim(ptext, {_SPACES}), 1) NOT IN ('.', '?', '!', ':', ';') AS joins FROM g),
n AS (SELECT doc, page, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc, page ORDER BY ord) AS n, y0, y1 FROM j)
SELECT doc, page, (n - 1)::INT AS ord, printf('p%04d-b%04d', page, n::INT) AS block_id, min(y0) AS y0, max(y1) AS y1, count(*)::INT AS n_merged FROM n GROUP BY doc, page, n""")
def older_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole blocks merged by the older rule, with dense numbers."""
    return paragraphs.merge_adjacent_blocks(adapters.wrapped(read_table(spark, sf_dir, "documents"))).select("doc", "page", "ord", "block_id", "y0", "y1", "n_merged")


# Layout

@query(f"""SELECT doc, count(*) AS n_blocks, count(*) FILTER (WHERE font_size < font_first) AS n_reduced, count(*) FILTER (WHERE expanded) AS n_expanded, count(*) FILTER (WHERE overflow) AS n_overflow FROM ({SQL["layout_plan"]}) GROUP BY doc""")
def layout_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document's layout: blocks, reduced fonts, expansions and overflows."""
    from quire.queries import layout_plan

    return layout.layout_counters(layout_plan(spark, sf_dir), "doc")


# Glossary

_TERMS = """terms AS (SELECT 'h' || (page_id % 150) AS id, regexp_extract(url, '://([^/?#]*)', 1) || CASE WHEN page_id % 6 = 0 THEN '  X' ELSE '' END AS source, CASE WHEN page_id % 9 = 0 THEN '' ELSE 'T' END AS target, CASE page_id % 4 WHEN 0 THEN 'preserve' WHEN 1 THEN 'other' ELSE 'translate' END AS mode, page_id % 2 = 0 AS case_sensitive, CASE page_id % 3 WHEN 0 THEN 'exact' ELSE 'phrase' END AS match, (page_id % 12000)::INT AS priority FROM pages)"""


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    return read_table(spark, sf_dir, "pages").select(
        F.concat(F.lit("h"), n % 150).alias("id"), F.concat(F.regexp_extract("url", "://([^/?#]*)", 1), F.when(n % 6 == 0, "  X").otherwise("")).alias("source"), F.when(n % 9 == 0, "").otherwise("T").alias("target"),
        F.when(n % 4 == 0, "preserve").when(n % 4 == 1, "other").otherwise("translate").alias("mode"), (n % 2 == 0).alias("case_sensitive"), F.when(n % 3 == 0, "exact").otherwise("phrase").alias("match"), F.lit("fixed").alias("inflection"), (n % 12_000).cast("int").alias("priority"),
    )


@query(f"""WITH {_TERMS}, e AS (SELECT *, trim(regexp_replace(source, '\\s+', ' ', 'g')) AS plain, lower(trim(regexp_replace(source, '\\s+', ' ', 'g'))) AS folded FROM terms), f AS (SELECT *, CASE WHEN case_sensitive THEN plain ELSE folded END AS effective FROM e)
SELECT 'repeated id' AS problem, min(effective) AS source, id AS first_id, id AS last_id, count(*) AS n FROM f GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'repeated source', effective, min(id), max(id), count(*) FROM f GROUP BY effective, match, case_sensitive HAVING count(*) > 1
UNION ALL SELECT 'two modes', folded, min(id), max(id), count(*) FROM f GROUP BY folded HAVING min(mode) <> max(mode)""")
def glossary_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts of a glossary of the pages' hosts: repeated ids, repeated sources of a kind, sources with two modes."""
    return glossary.term_conflicts(_terms(spark, sf_dir))


@query(f"""WITH {_TERMS}, p AS (SELECT id, unnest(list_filter([CASE WHEN trim(source) = '' THEN 'no source' END, CASE WHEN target = '' THEN 'no target' END, CASE WHEN mode = 'other' THEN 'unknown mode' END, CASE WHEN priority > 10000 THEN 'priority out of range' END], lambda x: x IS NOT NULL)) AS problem FROM terms)
SELECT id, problem, count(*) AS n FROM p GROUP BY id, problem""")
def glossary_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of a glossary of the pages' hosts that aren't valid."""
    return glossary.invalid_terms(_terms(spark, sf_dir)).groupBy("id", "problem").agg(F.count("*").alias("n"))


_VOCABULARY = """vocabulary AS (SELECT w, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z]+')) AS w FROM documents) WHERE length(w) >= 3 GROUP BY w ORDER BY n DESC, w LIMIT 1000)"""


@query(rf"""WITH {_VOCABULARY}, r AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[^\pL\pM\p{{Nd}}_]+')) AS w FROM documents)
SELECT doc_id, v.w AS term, count(*) AS n FROM r JOIN vocabulary v ON lower(r.w) = v.w GROUP BY doc_id, v.w""")
def vocabulary_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches in each document of a glossary of the thousand words that most documents have."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split(lowered, "[^a-z]+"))).alias("w")).where(F.length("w") >= 3).distinct()
    common = words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(1000)  # the size of the glossary
    given = {"mode": "translate", "match": "whole_word", "inflection": "fixed"}
    book = glossary.collected_glossary(common.select(F.col("w").alias("id"), F.col("w").alias("source"), F.upper("w").alias("target"), *[F.lit(v).alias(k) for k, v in given.items()], F.lit(False).alias("case_sensitive"), F.lit(0).alias("priority"), F.lit(None).cast("string").alias("notes")))
    found = docs.select("doc_id", F.explode(glossary.matches(F.col("text"), book)).alias("m"))
    return found.groupBy("doc_id", F.col("m.term").alias("term")).agg(F.count("*").alias("n"))


# Translation

@query(f"WITH {_UNITS} SELECT count(*) AS n_units, count(*) FILTER (WHERE status = 'skipped') AS n_skipped, count(*) FILTER (WHERE status = 'hit') AS n_hits, count(*) FILTER (WHERE status = 'miss') AS n_misses, count(*) FILTER (WHERE status = 'miss') AS n_segments FROM k")
def translation_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of a run over all turns with texts of one segment."""
    o = TranslationOptions(token_limit=1_000_000)
    planned = translate.plan_units(_units(spark, sf_dir), None, o)
    return translate.run_counters(translate.finish_units(planned, translate.translate_misses(planned.where("status = 'miss'"), o)))


@query("""SELECT conv_id, turn, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1) // 3)::BIGINT AS batch FROM conversations""")
def micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch of three of each turn of a conversation."""
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("conv_id").alias("doc"), F.struct("turn", "role", "text").alias("at"))
    return translate.batches_of(rows, "at", 3).select("conv_id", "turn", "batch")


@query("""SELECT 'c' || conv_id || '-t' || turn AS unit_id FROM conversations WHERE NOT (turn % 2 = 0 AND conv_id % 3 <> 0)""")
def pending_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a resumed run still has to do, if even turns are done, but for conversations whose texts have changed since."""
    units = _units(spark, sf_dir).where("text IS NOT NULL")
    text = F.when(F.col("unit_order.conv_id") % 3 == 0, F.concat("text", F.lit(" (old)"))).otherwise(F.col("text"))
    return translate.pending(units, units.where("unit_order.turn % 2 = 0").withColumn("text", text)).select("unit_id")


# Findings

@query(f"""WITH {_FINDINGS}, g AS (SELECT sample_id, code, severity, CASE code WHEN 'url-damaged' THEN 'protected_token' WHEN 'protected-token-damaged' THEN 'protected_token' ELSE 'model' END AS stage FROM f)
SELECT stage, count(*) AS n_current, 0::BIGINT AS n_historical, count(*) FILTER (WHERE severity = 'error') AS n_errors FROM g GROUP BY stage""")
def finding_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by the stage that they point at: identity, length, links and protected tokens."""
    kept = F.col("code").isin("untranslated-output", "suspicious-length-ratio", "url-damaged", "protected-token-damaged")
    return quality.stage_summary(quality.analyse(_samples(spark, sf_dir)).where(kept))


_TWO_RUNS = """r AS (SELECT doc_id, max(1 + 4 * quality) AS a, max(5 - 4 * toxic) AS b FROM labels GROUP BY doc_id),
w AS (SELECT doc_id, 'model' AS stage, 'human-adequacy' AS code FROM r WHERE a <= 2), n AS (SELECT doc_id, 'model' AS stage, 'human-adequacy' AS code FROM r WHERE a <= 2 AND doc_id % 3 <> 0 UNION SELECT doc_id, 'model', 'human-fluency' FROM r WHERE b <= 2)"""


@query(f"WITH {_TWO_RUNS} SELECT *, 'new' AS change FROM (SELECT * FROM n EXCEPT SELECT * FROM w) UNION ALL SELECT *, 'resolved' FROM (SELECT * FROM w EXCEPT SELECT * FROM n)")
def finding_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that a second review has and a first hadn't, and the other way round."""
    scores = _labels(spark, sf_dir).groupBy("doc_id").agg(F.max(1 + 4 * F.col("quality")).alias("adequacy"), F.max(5 - 4 * F.col("toxic")).alias("fluency"))
    first = quality.review_findings(scores.select("doc_id", "adequacy"), "doc_id")
    second = quality.review_findings(scores.select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("adequacy")).alias("adequacy"), "fluency"), "doc_id")
    return quality.finding_changes(first, second, "doc_id")


# Reports and runs

_RESULTS = """res AS (SELECT doc_id AS doc, CASE WHEN max(quality) = 1 THEN 'passed' ELSE 'failed' END AS status, max(toxic) = 1 AS source_changed, CASE doc_id % 4 WHEN 0 THEN 'fail' WHEN 1 THEN 'not_checked' WHEN 2 THEN 'pass' END AS checked FROM labels GROUP BY doc_id)"""
_CHECKS = ("layout", "terminology")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as a corpus that was run and, three of four, reviewed."""
    rows = _labels(spark, sf_dir).groupBy(F.col("doc_id").alias("doc")).agg(F.max("quality").alias("q"), (F.max("toxic") == 1).alias("source_changed"))
    status = F.when(F.col("q") == 1, "passed").otherwise("failed")
    rows = rows.select("doc", status.alias("status"), F.create_map(F.lit("extract"), F.lit("passed"), F.lit("translated"), status).alias("stages"), "source_changed")
    checked = F.when(F.col("doc") % 4 == 0, "fail").when(F.col("doc") % 4 == 1, "not_checked").when(F.col("doc") % 4 == 2, "pass")
    reviews = rows.where(checked.isNotNull()).select("doc", F.create_map(F.lit("layout"), F.lit("pass"), F.lit("terminology"), checked).alias("checks"))
    return reports.with_reviews(rows, reviews, _CHECKS)


@query(f"WITH {_RESULTS} SELECT doc, CASE checked WHEN 'fail' THEN 'fail' WHEN 'pass' THEN 'pass' ELSE 'pending' END AS manual FROM res")
def manual_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manual status of each document: of its review, or pending without one."""
    return _results(spark, sf_dir).select("doc", "manual")


@query(f"""WITH {_RESULTS} SELECT count(*) FILTER (WHERE status = 'passed') AS n_passed, count(*) FILTER (WHERE status = 'failed') AS n_failed, 0::BIGINT AS n_planned, count(*) FILTER (WHERE source_changed) AS n_integrity, count(*) FILTER (WHERE checked = 'pass') AS n_manual_pass, count(*) FILTER (WHERE checked = 'fail') AS n_manual_fail, count(*) FILTER (WHERE checked IS NULL OR checked = 'not_checked') AS n_manual_pending FROM res""")
def validation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals of the validation of a corpus."""
    return reports.validation_summary(_results(spark, sf_dir))


@query(f"""WITH {_RESULTS} SELECT doc, 'stage:translated' AS defect FROM res WHERE status = 'failed' UNION ALL SELECT doc, 'integrity:source' FROM res WHERE source_changed UNION ALL SELECT doc, 'manual:terminology' FROM res WHERE checked = 'fail'""")
def validation_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each failed stage, changed source and failed check."""
    return reports.defects(_results(spark, sf_dir))


@query("""WITH r AS (SELECT user_id AS run, count(*) AS n, CASE user_id % 6 WHEN 0 THEN 'input_error' WHEN 1 THEN 'ocr_required' WHEN 2 THEN 'interrupted' WHEN 3 THEN 'strange' END AS error FROM events GROUP BY user_id)
SELECT run, 'd' || run AS doc, 'failed' AS status, 'extract' AS stage, error, n || ' events' AS message, CASE error WHEN 'input_error' THEN 3 WHEN 'ocr_required' THEN 4 WHEN 'interrupted' THEN 130 ELSE 6 END AS exit_code FROM r WHERE error IS NOT NULL""")
def failure_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of the runs that failed, users as runs, with their exit codes."""
    n = F.col("run") % 6
    runs = _events(spark, sf_dir).groupBy(F.col("user_id").alias("run")).agg(F.count("*").alias("n"))
    error = F.when(n == 0, "input_error").when(n == 1, "ocr_required").when(n == 2, "interrupted").when(n == 3, "strange")
    return reports.failure_report(runs.select("run", F.concat(F.lit("d"), "run").alias("doc"), F.lit("extract").alias("stage"), error.alias("error"), F.concat("n", F.lit(" events")).alias("message")))


_RECORDS = """rec AS (SELECT user_id AS doc, count(*) AS n_total, count(*) FILTER (WHERE event_type <> 'click') + CASE WHEN user_id % 5 = 0 THEN 100000 ELSE 0 END AS n_completed, count(*) FILTER (WHERE value > 50) AS n_skipped, min(ts) AS started, CASE WHEN user_id % 7 = 0 THEN min(ts) - INTERVAL 1 DAY ELSE max(ts) END AS updated, CASE WHEN user_id % 2 = 0 THEN 'completed' ELSE 'in_progress' END AS status, CASE WHEN user_id % 3 = 0 THEN max(ts) END AS completed FROM events GROUP BY user_id)"""


@query(f"""WITH {_RECORDS}, v AS (SELECT doc, unnest(list_filter([CASE WHEN n_completed > n_total THEN 'more completed than there are' END, CASE WHEN n_skipped > n_completed THEN 'more skipped than completed' END, CASE WHEN updated < started THEN 'updated before it started' END, CASE WHEN status = 'completed' AND n_completed <> n_total THEN 'completed with units left' END, CASE WHEN status = 'completed' AND completed IS NULL THEN 'completed without its time' END, CASE WHEN status <> 'completed' AND completed IS NOT NULL THEN 'time of completion too early' END], lambda x: x IS NOT NULL)) AS violation FROM rec)
SELECT doc, violation FROM v""")
def lifecycle_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can't be so in the records of runs that are made of users' events."""
    u, least, most = F.col("user_id"), F.min("ts"), F.max("ts")
    runs = _events(spark, sf_dir).groupBy("user_id").agg(
        F.count("*").alias("n_total"), (F.count_if(F.col("event_type") != "click") + F.when(u % 5 == 0, 100_000).otherwise(0)).alias("n_completed"), F.count_if(F.col("value") > 50).alias("n_skipped"), least.alias("started"),
        F.when(u % 7 == 0, least - F.expr("INTERVAL 1 DAY")).otherwise(most).alias("updated"), F.when(u % 2 == 0, "completed").otherwise("in_progress").alias("status"), F.when(u % 3 == 0, most).alias("completed"),
    )
    return reports.lifecycle_violations(runs.withColumnRenamed("user_id", "doc"))


@query("""WITH f AS (SELECT user_id, event_type, min(event_id) AS place FROM events GROUP BY user_id, event_type)
SELECT f.user_id, string_agg(event_type, ',' ORDER BY place) AS warnings, any_value(first_purchase) AS first_purchase FROM f JOIN (SELECT user_id, arg_min(CASE WHEN event_type = 'purchase' THEN value END, CASE WHEN event_type = 'purchase' THEN event_id END) AS first_purchase FROM events GROUP BY user_id) p ON f.user_id = p.user_id GROUP BY f.user_id""")
def first_and_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's kinds of events in the order of their first occurrence, and the value of the first purchase."""
    events = _events(spark, sf_dir)
    kinds = checks.distinct_in_order(events.select("user_id", F.col("event_id").alias("place"), F.col("event_type").alias("warning")), "user_id")
    bought = events.withColumn("bought", F.when(F.col("event_type") == "purchase", F.col("value"))).groupBy("user_id").agg(checks.first_known("bought", "event_id").alias("first_purchase"))
    return kinds.join(bought, "user_id").select("user_id", F.array_join("warnings", ",").alias("warnings"), "first_purchase")


@query("""WITH n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events)
SELECT event_id, n < 2 AS warmup, CASE WHEN n < 2 THEN n ELSE n - 2 END AS iteration FROM n""")
def numbered_iterations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as runs of a benchmark, of which the first two are warm-ups."""
    rows = checks.iterations(_events(spark, sf_dir).select("event_id", F.col("user_id").alias("batch"), F.col("event_id").alias("place")), 2)
    return rows.select("event_id", "warmup", _long(F.col("iteration")).alias("iteration"))


@query("""WITH r AS (SELECT user_id % 8 + 1 AS batch, user_id % 8 AS place, event_id % 10 = 0 AS warmup, event_id % 50 AS n, value AS seconds FROM events),
m AS (SELECT batch, place, median(CASE WHEN seconds <= 0 OR n <= 0 THEN 0.0::DOUBLE ELSE n / seconds END) AS rate FROM r WHERE NOT warmup GROUP BY batch, place)
SELECT batch, rate FROM m ORDER BY rate DESC, place LIMIT 1""")
def best_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch size of the best median rate, with values of events as seconds."""
    runs = _events(spark, sf_dir).select((F.col("user_id") % 8 + 1).alias("batch"), (F.col("user_id") % 8).alias("place"), (F.col("event_id") % 10 == 0).alias("warmup"), (F.col("event_id") % 50).alias("n"), F.col("value").alias("seconds"))
    return performance.best_batch(runs)


@query("SELECT event_type, count(*) AS n, CASE WHEN sum(value) <= 0 OR sum(value) IS NULL THEN 0.0::DOUBLE ELSE round(count(*) / sum(value), 9) END AS rate FROM events GROUP BY event_type")
def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each kind for each unit of their values."""
    sums = _events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("s"))
    return sums.select("event_type", "n", F.round(performance.rate(F.col("n"), F.col("s")), 9).alias("rate"))


@query(f"""WITH o AS (SELECT doc_id, text, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN left(text, 30) || '__KEEP_0001__' ELSE text END AS translated, list_distinct(coalesce(regexp_extract_all(text, '{T.URL}'), [])) AS tokens FROM documents)
SELECT count(*) AS n_units, count(translated) AS n_outputs, count(*) FILTER (WHERE regexp_matches(translated, '__(KEEP|TERM)_[0-9]{{4,}}__')) AS n_leaks, sum(len(list_filter(tokens, lambda t: NOT contains(coalesce(translated, ''), t))))::BIGINT AS n_lost, false AS passed FROM o""")
def output_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked marks, lost links and missing outputs of derived translations."""
    d = F.col("doc_id")
    translated = F.when(d % 5 == 0, None).when(d % 3 == 0, F.concat(F.left("text", F.lit(30)), F.lit("__KEEP_0001__"))).otherwise(F.col("text"))
    tokens = F.array_distinct(F.coalesce(F.regexp_extract_all("text", F.lit(T.URL), 0), F.array().cast("array<string>")))
    return performance.integrity(_documents(spark, sf_dir).select("text", translated.alias("translated"), tokens.alias("tokens")))


@query("""SELECT role, count(DISTINCT sha256(coalesce(text, ''))) = 1 AS identical FROM conversations GROUP BY role""")
def identical_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all turns of a role are the same text."""
    hashes = read_table(spark, sf_dir, "conversations").select("role", performance.content_hash(F.coalesce("text", F.lit("")).cast("binary")).alias("hash"))
    return performance.same_outputs(hashes, "role")


@query("""SELECT d.source, count(*) AS n FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) GROUP BY d.source""")
def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source that no label refers to."""
    docs = _documents(spark, sf_dir)
    missing = checks.dangling(docs.select("doc_id"), _labels(spark, sf_dir), "doc_id")
    return docs.join(missing, "doc_id").groupBy("source").agg(F.count("*").alias("n"))


@query("""SELECT lower(trim(split_part(text, ' ', 1))) AS id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1""")
def repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First words of documents that several begin with, in any case of letters."""
    return checks.repeated_ids(_documents(spark, sf_dir).select(F.trim(F.split_part("text", F.lit(" "), F.lit(1))).alias("w")), "w")


@query("""SELECT source, array_to_string(list_sort(list_filter(langs, lambda l: l NOT IN ('en', 'de'))), ',') AS missing FROM (SELECT source, list_distinct(list(lang)) AS langs FROM documents GROUP BY source)""")
def missing_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of each source's documents that aren't installed, where English and German are."""
    asked = _documents(spark, sf_dir).groupBy("source").agg(F.collect_set("lang").alias("langs"))
    return asked.select("source", F.array_join(F.array_sort(checks.missing_languages(F.col("langs"), F.array(F.lit("en"), F.lit("de")))), ",").alias("missing"))


@query("""WITH r AS (SELECT user_id AS run, user_id % 3 AS model, user_id % 2 AS language FROM events GROUP BY user_id)
SELECT run, array_to_string(list_filter([CASE WHEN model <> 1 THEN 'model' END, CASE WHEN language <> 0 THEN 'language' END], lambda x: x IS NOT NULL), ',') AS differ, model = 1 AND language = 0 AS resumable FROM r""")
def compatible_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts in which stored runs differ from a wanted one."""
    runs = _events(spark, sf_dir).select(F.col("user_id").alias("run"), (F.col("user_id") % 3).alias("model"), (F.col("user_id") % 2).alias("language")).distinct()
    found = checks.compatible_runs(runs, {"model": 1, "language": 0})
    return found.select("run", F.array_join("differ", ",").alias("differ"), "resumable")

"""The registered queries over the layout operators, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import CODE_LINE, DRIVE_PATH, EMAIL, LIGATURES, MEASUREMENTS, SPACES, URL, cache_key, normalize, protect, restore, segment, skips_translation
from quire.operators import layout, pages, paragraphs, performance, quality, repeated, reports, translate, typeset
from quire.operators.glossary import Glossary, Term, compliance, glossary_matches, statistics
from quire.operators.typeset import FULL_WIDTH, FontMetrics
from quire.plans.options import LayoutOptions, TranslationOptions
from quire.plans.scratch import settle
from quire.sources import adapters
from quire.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: SQL for a text with ligatures expanded, in NFC; and for white space of Unicode at the ends of one.
_SOURCE = "text"
for _one, _many in LIGATURES:
    _SOURCE = f"replace({_SOURCE}, '{_one}', '{_many}')"
_SOURCE = f"nfc_normalize({_SOURCE})"
_SPACES = "'" + "'||chr(28)||chr(29)||chr(30)||chr(31)||'".join(SPACES.split("\x1c\x1d\x1e\x1f")) + "'"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with the SQL for its rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.furniture(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def _stored_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, written once, for queries that read the blocks several times."""
    return settle(_furniture(spark, sf_dir))


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.units(read_table(spark, sf_dir, "conversations"))


# Pages

@query(f"""
WITH {adapters.FURNITURE_SQL},
p AS (SELECT doc, page, sum(length(trim(text))) AS chars, count(*) AS n FROM blocks GROUP BY doc, page)
SELECT doc, count(*) FILTER (WHERE chars >= 20 OR n > 1) AS text_pages, 0::BIGINT AS scanned_pages, 0::BIGINT AS mixed_pages, 0::BIGINT AS empty_pages, count(*) AS n_pages, sum(n)::BIGINT AS n_blocks, 0::BIGINT AS n_images FROM p GROUP BY doc""")
def page_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page classes of each logical document."""
    found = pages.page_text(_furniture(spark, sf_dir)).withColumns({"images": F.lit(0), "image_area": F.lit(0.0)})
    return pages.inspect(pages.classify_pages(found), "doc")


@query(r"""
WITH h AS (SELECT url AS doc, length(trim(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'))) AS chars, len(regexp_extract_all(html, '<div class="ad"')) AS images FROM pages),
c AS (SELECT *, least(0.2 * images, 1.0) AS ratio, CASE WHEN images > 0 AND chars < 20 THEN 'scanned' WHEN images > 0 AND chars >= 20 AND least(0.2 * images, 1.0) >= 0.15 THEN 'mixed' ELSE 'text' END AS class FROM h)
SELECT class, count(*) AS n_pages, sum(images)::BIGINT AS n_images FROM c GROUP BY class""")
def html_page_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages by class, with advertisements as images."""
    return pages.classify_pages(adapters.html_pages(read_table(spark, sf_dir, "pages"))).groupBy("class").agg(F.count("*").alias("n_pages"), F.sum("images").cast("long").alias("n_images"))


@query("""
WITH s AS (SELECT doc_id, coalesce(length(regexp_replace(text, '[^A-Za-z]', '', 'g')), 0) AS latin, coalesce(length(regexp_replace(text, '[^А-Яа-яЁё]', '', 'g')), 0) AS cyrillic FROM documents)
SELECT doc_id, latin, cyrillic, CASE WHEN latin + cyrillic >= 20 THEN CASE WHEN latin / (latin + cyrillic) >= 0.7 THEN 'en' WHEN cyrillic / (latin + cyrillic) >= 0.7 THEN 'ru' ELSE 'mixed' END END AS language FROM s""")
def language_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters by script and the probable language of each document."""
    return pages.languages(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


# Repeated elements

_REPEATED = rf"""{adapters.FURNITURE_SQL},
rc AS (SELECT *, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g')) AS norm, CASE WHEN y1 <= page_h * 0.12::DOUBLE THEN 'top' WHEN y0 >= page_h * (1 - 0.12::DOUBLE) THEN 'bottom' ELSE 'middle' END AS region FROM blocks),
rs AS (SELECT *, region <> 'middle' AND coalesce(try_cast(regexp_extract(text, '{repeated.PAGE_NUMBER}', 1) AS BIGINT) = page, false) AS sequential FROM rc),
rd AS (SELECT doc, min(page) AS first_page, max(page) AS last_page, count(DISTINCT page) AS n_pages, count(DISTINCT page) FILTER (WHERE page % 2 = 1) AS n_odd, count(DISTINCT page) FILTER (WHERE page % 2 = 0) AS n_even, median(font) AS doc_font, count(DISTINCT page) FILTER (WHERE sequential) AS number_pages FROM rs GROUP BY doc),
rt AS (SELECT s.*, d.number_pages >= 2 AS numbered FROM rs s JOIN rd d ON s.doc = d.doc),
rg AS (SELECT doc, norm, list_sort(list(DISTINCT page)) AS pages, min(region) AS region, max(region) AS region_max, greatest(max(x0 / page_w) - min(x0 / page_w), max(y0 / page_h) - min(y0 / page_h), max(x1 / page_w) - min(x1 / page_w), max(y1 / page_h) - min(y1 / page_h)) AS spread,
  max(font) - min(font) AS font_spread, median(font) AS font_mid, min(font) AS font_least, min(y0 / page_h) AS y_least, max(y0 / page_h) AS y_most, count(*) AS n_blocks FROM rt WHERE NOT (sequential AND numbered) GROUP BY doc, norm HAVING norm <> '' AND count(DISTINCT page) >= 2),
rr AS (SELECT g.*, d.* EXCLUDE (doc), len(g.pages)::DOUBLE / greatest(d.n_pages - (NOT list_contains(pages, first_page))::INT - (NOT list_contains(pages, last_page))::INT, 1) AS raw, len(list_filter(pages, lambda p: p % 2 = 1))::DOUBLE / greatest(n_odd, 1) AS odd, len(list_filter(pages, lambda p: p % 2 = 0))::DOUBLE / greatest(n_even, 1) AS even FROM rg g JOIN rd d ON g.doc = d.doc),
rp AS (SELECT *, CASE WHEN odd > raw AND odd >= even THEN 'odd' WHEN even > raw THEN 'even' ELSE 'all' END AS parity, least(raw, 1.0::DOUBLE) AS ratio FROM rr),
rk AS (SELECT *, region = region_max AND spread <= 0.035 AS geometry, font_spread <= greatest(0.5, font_mid * 0.18) AS fonts, (ratio >= 0.6 OR (parity = 'odd' AND odd >= 0.75) OR (parity = 'even' AND even >= 0.75)) AND n_pages >= 3 AS recurring,
  {" OR ".join(f"contains(norm, '{c}')" for c in repeated.LEGAL)} AS legal, y_least >= 0.25 AND y_most <= 0.75 AND (font_least >= doc_font * 1.6 OR norm IN ({", ".join(f"'{c}'" for c in repeated.WATERMARK)})) AS conspicuous FROM rp),
rx AS (SELECT *, CASE WHEN geometry AND recurring AND legal THEN 'repeated_boilerplate' WHEN geometry AND recurring AND conspicuous THEN 'watermark_candidate' WHEN geometry AND fonts AND recurring AND region IN ('top', 'bottom') THEN CASE region WHEN 'top' THEN 'running_header' ELSE 'running_footer' END WHEN geometry AND fonts THEN 'unknown_repeated' END AS kind FROM rk),
groups AS (SELECT doc, norm, kind, parity, ratio, n_blocks, 'repeat-' || left(sha256(kind || chr(0) || norm || chr(0) || parity), 12) AS group_id, len(pages)::BIGINT AS n_pages FROM rx WHERE kind IS NOT NULL
  UNION ALL SELECT doc, 'page-sequence', 'page_number', 'sequence', number_pages::DOUBLE / n_pages, number_pages, 'repeat-' || left(sha256('page_number' || chr(0) || 'page-sequence' || chr(0) || 'sequence'), 12), number_pages FROM rd WHERE number_pages >= 2),
labelled AS (SELECT t.doc, t.page, t.block_id, CASE WHEN t.sequential AND t.numbered THEN 'page_number' ELSE coalesce(g.kind, 'body') END AS kind,
  CASE WHEN t.sequential AND t.numbered THEN 'repeat-' || left(sha256('page_number' || chr(0) || 'page-sequence' || chr(0) || 'sequence'), 12) ELSE g.group_id END AS group_id FROM rt t LEFT JOIN groups g ON t.doc = g.doc AND t.norm = g.norm AND g.parity <> 'sequence')"""


@query(f"WITH {_REPEATED} SELECT kind, count(*) AS n_blocks, count(*) FILTER (WHERE kind IN ('watermark_candidate', 'unknown_repeated')) AS n_ambiguous, count(DISTINCT doc || group_id) AS n_groups FROM labelled GROUP BY kind")
def repeated_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks, ambiguous ones and groups of each kind of repeated element."""
    return repeated.kind_totals(_stored_furniture(spark, sf_dir))


@query(f"WITH {_REPEATED} SELECT doc, norm, kind, parity, ratio, n_blocks, group_id, n_pages FROM groups")
def repeated_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of repeated texts and page sequences."""
    o = repeated.RepeatedOptions()
    groups = repeated.repeated_groups(repeated.candidates(_stored_furniture(spark, sf_dir), o), o)
    return groups.select("doc", "norm", "kind", "parity", "ratio", "n_blocks", "group_id", "n_pages")


@query(f"WITH {_REPEATED} SELECT doc, page, block_id, kind, group_id FROM labelled")
def repeated_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind and group of every block."""
    return repeated.classify_repeated(_stored_furniture(spark, sf_dir)).select("doc", "page", "block_id", "kind", "group_id")


# Paragraphs

_COLUMNS = adapters.wrapped_sql(6, 50, 2)


@query(f"""WITH {_COLUMNS} SELECT DISTINCT a.doc, a.page FROM blocks a JOIN blocks b ON a.doc = b.doc AND a.page = b.page AND a.y0 < b.y1 AND b.y0 < a.y1
WHERE a.x1 <= a.page_w / 2 - a.page_w * 0.04 AND b.x0 >= a.page_w / 2 + a.page_w * 0.04""")
def two_column_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages set in two columns."""
    return paragraphs.two_column_pages(adapters.wrapped(read_table(spark, sf_dir, "documents"), 6, 50, 2))


@query(f"""WITH {_COLUMNS}, t AS (SELECT doc, page, max(x1 > 300) AS two FROM blocks GROUP BY doc, page)
SELECT b.doc, b.page, b.block_id, CASE WHEN t.two AND b.x0 >= 300 THEN 1 ELSE 0 END AS "column", row_number() OVER (PARTITION BY b.doc, b.page ORDER BY CASE WHEN t.two AND b.x0 >= 300 THEN 1 ELSE 0 END, b.y0, b.x0, b.block_id)::INT AS seq FROM blocks b JOIN t ON b.doc = t.doc AND b.page = t.page""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading order of blocks on pages of two columns."""
    return paragraphs.reading_order(adapters.wrapped(read_table(spark, sf_dir, "documents"), 6, 50, 2)).select("doc", "page", "block_id", "column", "seq")


_SOFT = r"regexp_matches({a}, '(^|\s)\pL{{3,}}-$') AND regexp_matches({b}, '^\s*\p{{Ll}}') AND NOT contains(regexp_extract({b}, '^\s*(\S+)', 1), '-') AND lower(regexp_extract({a}, '(\S+)-$', 1)) NOT IN ('well', 'ill', 'self', 'non', 'pre', 'post', 'high', 'low', 'long', 'short')"
_PARAGRAPHS = rf"""{adapters.wrapped_sql()},
pk AS (SELECT *, regexp_replace(text, '\PL', '', 'g') AS letters FROM blocks),
pl AS (SELECT *, CASE WHEN regexp_matches(text, '^\s*(?:[•◦▪‣]|[-*+]\s|\(?\d+[.)]\s|[A-Za-z][.)]\s)') THEN 'list_item' WHEN regexp_matches(text, '(?i)^\s*(?:figure|fig\.?|table|chart|image)\s+\d+\b') THEN 'caption'
  WHEN letters <> '' AND upper(letters) = letters AND regexp_matches(letters, '\p{{Lu}}') THEN 'heading' ELSE 'body' END AS kind FROM pk),
pd AS (SELECT *, lag(kind) OVER w AS pkind, lag(text) OVER w AS ptext, lag(block_id) OVER w AS pblock FROM pl WINDOW w AS (PARTITION BY doc, page ORDER BY y0, x0, block_id)),
pf AS (SELECT *, regexp_matches(text, '^\s*\p{{Ll}}') AS lower_start, rtrim(ptext, {_SPACES}) <> '' AND right(rtrim(ptext, {_SPACES}), 1) NOT IN ('.', '?', '!', ':', ';') AS open_end, {_SOFT.format(a=f"rtrim(ptext, {_SPACES})", b="text")} AS soft FROM pd),
pa AS (SELECT *, CASE WHEN pkind IS NULL THEN NULL WHEN pkind <> 'body' OR kind <> 'body' THEN 'keep' WHEN soft OR lower_start OR open_end THEN 'merge' ELSE 'ambiguous' END AS action FROM pf),
pb AS (SELECT *, sum(CASE WHEN action = 'merge' THEN 0 ELSE 1 END) OVER (PARTITION BY doc, page ORDER BY y0, x0, block_id) AS local, lead(action) OVER (PARTITION BY doc, page ORDER BY y0, x0, block_id) AS after FROM pa),
pg AS (SELECT doc, page, local, min(kind) AS kind, min(y0) AS y0, max(y1) AS y1, arg_min(text, y0) AS head, arg_max(text, y0) AS tail, count(*) AS n FROM pb GROUP BY doc, page, local),
pq AS (SELECT *, lag(page) OVER w AS qpage, lag(kind) OVER w AS qkind, lag(y1) OVER w AS qy1, lag(tail) OVER w AS qtail FROM pg WINDOW w AS (PARTITION BY doc ORDER BY page, local)),
pr AS (SELECT *, CASE WHEN qpage IS NULL OR qpage = page THEN NULL WHEN page <> qpage + 1 OR qkind <> 'body' OR kind <> 'body' THEN 'keep'
  WHEN regexp_matches(head, '^\s*\p{{Ll}}') OR (rtrim(qtail, {_SPACES}) <> '' AND right(rtrim(qtail, {_SPACES}), 1) NOT IN ('.', '?', '!', ':', ';')) THEN CASE WHEN qy1 >= 800 * 0.82::DOUBLE AND y0 <= 800 * 0.18::DOUBLE THEN 'merge' ELSE 'ambiguous' END ELSE 'keep' END AS action, {_SOFT.format(a=f"rtrim(qtail, {_SPACES})", b="head")} AS soft FROM pq)"""


@query(f"WITH {_PARAGRAPHS} SELECT action, cross_page, count(*) AS n FROM (SELECT action, false AS cross_page FROM pa UNION ALL SELECT action, true FROM pr) WHERE action IS NOT NULL GROUP BY action, cross_page")
def paragraph_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions between neighbouring lines, and across pages."""
    _, decisions = paragraphs.paragraphs_of(adapters.wrapped(read_table(spark, sf_dir, "documents")))
    return decisions.groupBy("action", "cross_page").agg(F.count("*").alias("n"))


@query(f"""WITH {_PARAGRAPHS},
x AS (SELECT doc, count(*) AS raw_lines, count(DISTINCT block_id) AS raw_blocks, count(*) FILTER (WHERE action = 'ambiguous') AS amb, count(action) AS n_dec, count(*) FILTER (WHERE action = 'merge' AND soft) AS soft FROM pa GROUP BY doc),
y AS (SELECT doc, count(*) FILTER (WHERE action IS DISTINCT FROM 'merge') AS n_paragraphs, count(action) AS n_dec, count(*) FILTER (WHERE action = 'ambiguous') AS amb, count(*) FILTER (WHERE action = 'merge') AS cross_merges, count(*) FILTER (WHERE action = 'merge' AND soft) AS soft FROM pr GROUP BY doc)
SELECT x.doc, raw_lines, raw_blocks, n_paragraphs, raw_lines - n_paragraphs AS merged, x.n_dec + y.n_dec AS n_decisions, x.amb + y.amb AS n_ambiguous, cross_merges AS cross_page_merges, x.soft + y.soft AS soft_hyphens FROM x JOIN y ON x.doc = y.doc""")
def paragraph_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reconstruction counters of each document."""
    return paragraphs.paragraph_metrics(adapters.wrapped(read_table(spark, sf_dir, "documents")))


@query()
def paragraph_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of the logical paragraphs."""
    return paragraphs.logical_paragraphs(adapters.wrapped(read_table(spark, sf_dir, "documents"), span=paragraphs.RANGE))


# Text

@query(rf"""
WITH u AS (SELECT conv_id, turn, trim({_SOURCE}, {_SPACES}) AS t FROM conversations)
SELECT conv_id, turn, t = '' OR regexp_matches(t, '^\d+$') OR regexp_matches(t, '{MEASUREMENTS}')
  OR (regexp_matches(t, '^[A-Z0-9][A-Z0-9_.:/\\-]*$') AND (regexp_matches(t, '\d') OR contains(t, '/'))) OR regexp_matches(t, '{CODE_LINE}') AS skipped FROM u""")
def skip_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that a translation passes on as they are."""
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", skips_translation(F.coalesce("text", F.lit(""))).alias("skipped"))


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{URL}'))::BIGINT AS n_urls, len(regexp_extract_all(text, '{EMAIL}'))::BIGINT AS n_emails, len(regexp_extract_all(text, '{DRIVE_PATH}'))::BIGINT AS n_paths FROM documents")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, mail addresses and drive paths of each document."""
    n = lambda pattern: F.size(F.regexp_extract_all("text", F.lit(pattern), 0)).cast("long")
    return read_table(spark, sf_dir, "documents").select("doc_id", n(URL).alias("n_urls"), n(EMAIL).alias("n_emails"), n(DRIVE_PATH).alias("n_paths"))


@query()
def protected_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens each document has protected, and whether restoring them gives the text again."""
    rows = read_table(spark, sf_dir, "documents").select("doc_id", "text", protect(F.col("text")).alias("p"))
    return rows.select("doc_id", F.size("p.tokens").cast("long").alias("n_tokens"), (restore(F.col("p.text"), F.col("p.tokens")) == F.col("text")).alias("round_trip"))


@query()
def sentence_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of each document for a model of 64 tokens."""
    rows = read_table(spark, sf_dir, "documents").select("doc_id", segment(F.col("text"), 64).alias("s"))
    return rows.select("doc_id", F.size("s.segments").cast("long").alias("n_segments"), F.col("s.forced").alias("forced"))


_NORMALIZED = rf"trim(regexp_replace(regexp_replace({_SOURCE}, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), {_SPACES})"


@query(rf"SELECT doc_id, sha256('3' || chr(0) || 'fake' || chr(0) || 'prefix' || chr(0) || 'en' || chr(0) || 'ru' || chr(0) || 'no-glossary' || chr(0) || {_NORMALIZED}) AS cache_key FROM documents")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memory key of each document's text."""
    o = TranslationOptions()
    return read_table(spark, sf_dir, "documents").select("doc_id", cache_key(normalize(F.col("text")), o.backend, o.model, o.source, o.target).alias("cache_key"))


# Glossary and translation

GLOSSARY = Glossary((Term("the-of", "the of", "T-OF", priority=20), Term("of", "of", "OF", match="whole_word", priority=10), Term("und", "und", "UND", mode="preserve", match="whole_word"), Term("case", "The", "THE", case_sensitive=True, match="whole_word")))
_MATCHES = r"""
g AS (SELECT doc_id, string_split(regexp_replace(text, '([^\pL\pM\p{Nd}_]+)', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS t FROM documents),
w AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM g),
x AS (SELECT doc_id, w, i, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS b, lag(w, 2) OVER (PARTITION BY doc_id ORDER BY i) AS a, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS c, lead(w, 2) OVER (PARTITION BY doc_id ORDER BY i) AS d FROM w),
m AS (SELECT doc_id, CASE WHEN lower(w) = 'of' THEN CASE WHEN lower(a) = 'the' AND regexp_matches(b, '^\s+$') THEN 'the-of' ELSE 'of' END WHEN lower(w) = 'und' THEN 'und' WHEN w = 'The' AND NOT coalesce(lower(d) = 'of' AND regexp_matches(c, '^\s+$'), false) THEN 'case' END AS term FROM x)"""


@query(f"WITH {_MATCHES} SELECT doc_id, term, count(*) AS n FROM m WHERE term IS NOT NULL GROUP BY doc_id, term")
def glossary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected glossary matches of each document."""
    return glossary_matches(read_table(spark, sf_dir, "documents").select("doc_id", "text"), GLOSSARY, key="doc_id").groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@query(f"""WITH {_MATCHES} SELECT 4::BIGINT AS n_terms, count(DISTINCT term) AS n_matched, 4 - count(DISTINCT term) AS n_unmatched, count(term) AS n_occurrences, count(*) FILTER (WHERE term = 'und') AS n_preserved, count(*) FILTER (WHERE term <> 'und') AS n_required FROM m""")
def glossary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glossary statistics of a run over all documents."""
    return statistics(glossary_matches(read_table(spark, sf_dir, "documents").select("doc_id", "text"), GLOSSARY, key="doc_id"), GLOSSARY)


@query()
def glossary_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the stand-in translation with glossary has every required target."""
    units = _units(spark, sf_dir)
    o = TranslationOptions(token_limit=4096)
    planned = translate.plan_units(units, None, o, GLOSSARY)
    finished = translate.finish_units(planned, translate.translate_misses(planned.where("status = 'miss'"), o, glossary=GLOSSARY))
    found = glossary_matches(units.join(planned.where("status <> 'skipped'").select("unit_id"), "unit_id", "left_semi"), GLOSSARY)
    return compliance(found.where("fixed"), finished.select("unit_id", "translated"))


_UNITS = rf"""u AS (SELECT 'c' || conv_id || '-t' || turn AS unit_id, conv_id, turn, text, {_NORMALIZED} AS n FROM conversations),
v AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY conv_id, turn) = 1 AS is_first, s.skipped FROM u JOIN ({SQL["skip_units"]}) s USING (conv_id, turn)),
k AS (SELECT unit_id, text, n, conv_id, turn, CASE WHEN skipped THEN 'skipped' WHEN is_first THEN 'miss' ELSE 'hit' END AS status, first_value(text) OVER (PARTITION BY n ORDER BY conv_id, turn) AS t FROM v)"""

@query(f"WITH {_UNITS} SELECT unit_id, status, CASE WHEN status = 'skipped' THEN text ELSE 'RU ' || t END AS translated FROM k")
def translate_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn's status and translation by the stand-in model, each distinct text translated once."""
    o = TranslationOptions(token_limit=1_000_000)
    planned = translate.plan_units(_units(spark, sf_dir), None, o)
    done = translate.translate_misses(planned.where("status = 'miss'"), o)
    return translate.finish_units(planned, done).select("unit_id", "status", "translated")


@query(f"WITH {_UNITS} SELECT status, count(*) AS n, count(DISTINCT n) AS n_texts FROM k GROUP BY status")
def dedup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and distinct texts by status."""
    planned = translate.plan_units(_units(spark, sf_dir), None, TranslationOptions())
    return planned.groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("normalized").alias("n_texts"))


@query(f"""WITH {_UNITS}, h AS (SELECT DISTINCT n FROM k WHERE status = 'miss' AND conv_id % 2 = 0)
SELECT CASE WHEN status <> 'skipped' AND k.n IN (SELECT n FROM h) THEN 'hit' ELSE status END AS status, count(*) AS n FROM k GROUP BY 1""")
def memory_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status counts of a run whose memory holds what the misses of even conversations gave."""
    units, o = _units(spark, sf_dir), TranslationOptions(token_limit=1_000_000)
    planned = translate.plan_units(units, None, o)
    memory = translate.new_memory(translate.translate_misses(planned.where("status = 'miss' AND unit_order.conv_id % 2 = 0"), o))
    return translate.plan_units(units, memory, o).groupBy("status").agg(F.count("*").alias("n"))


# Quality

def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sources, their links as protected tokens; the output drops digits where doc_id is odd and is cut short where it is divisible by 7."""
    rows = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.col("text").alias("source"))
    changed = F.when(F.col("sample_id") % 2 == 1, F.regexp_replace("source", "[0-9]", "")).otherwise(F.concat(F.lit("RU "), "source"))
    output = F.when(F.col("sample_id") % 7 == 0, F.left("source", F.lit(10))).otherwise(changed)
    return rows.withColumns({"output": output, "protected": F.array_distinct(F.coalesce(F.regexp_extract_all("source", F.lit(URL), 0), F.array().cast("array<string>"))), "n_segments": F.lit(1), "n_outputs": F.lit(1), "forced": F.lit(False)})


_FINDINGS = rf"""
s AS (SELECT doc_id AS sample_id, text AS source, CASE WHEN doc_id % 7 = 0 THEN left(text, 10) WHEN doc_id % 2 = 1 THEN regexp_replace(text, '[0-9]', '', 'g') ELSE 'RU ' || text END AS output FROM documents),
n AS (SELECT sample_id, lower(trim(regexp_replace(source, '\s+', ' ', 'g'))) AS a, lower(trim(regexp_replace(output, '\s+', ' ', 'g'))) AS b FROM s),
v AS (SELECT sample_id, output, regexp_extract_all(source, '{URL}') AS before, regexp_extract_all(output, '{URL}') AS after FROM s),
f AS (SELECT sample_id, 'untranslated-output' AS code, 'error' AS severity FROM n WHERE a <> '' AND a = b
  UNION ALL SELECT sample_id, 'suspicious-length-ratio', 'warning' FROM n WHERE a <> '' AND b <> '' AND (length(b) / length(a) < 0.25 OR length(b) / length(a) > 4)
  UNION ALL SELECT sample_id, 'protected-token-damaged', 'error' FROM v WHERE len(list_filter(before, lambda x: NOT contains(output, x))) > 0
  UNION ALL SELECT sample_id, 'url-damaged', 'error' FROM v WHERE len(list_filter(before, lambda x: len(list_filter(before, lambda y: y = x)) > len(list_filter(after, lambda y: y = x)))) > 0)"""


@query(f"WITH {_FINDINGS} SELECT code, severity, count(*) AS n FROM f GROUP BY code, severity")
def quality_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings on derived outputs whose checks SQL can repeat: identity, length, links and protected tokens; the case queries meet all codes."""
    return quality.analyse(_samples(spark, sf_dir)).where(F.col("code").isin("untranslated-output", "suspicious-length-ratio", "url-damaged", "protected-token-damaged")).groupBy("code", "severity").agg(F.count("*").alias("n"))


@query()
def quality_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of each sample by all checks."""
    samples = _samples(spark, sf_dir)
    return quality.statuses(samples, quality.analyse(samples))


@query("""WITH r AS (SELECT doc_id, max(1 + 4 * quality) AS adequacy, max(5 - 4 * toxic) AS fluency FROM labels GROUP BY doc_id)
SELECT doc_id, 'human-adequacy' AS code, 'model' AS stage, 'error' AS severity, adequacy AS score FROM r WHERE adequacy <= 2 UNION ALL SELECT doc_id, 'human-fluency', 'model', 'error', fluency FROM r WHERE fluency <= 2""")
def review_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings from human scores, made of the labels."""
    scores = read_table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(1 + 4 * F.col("quality")).alias("adequacy"), F.max(5 - 4 * F.col("toxic")).alias("fluency"))
    return quality.review_findings(scores, "doc_id")


@query("""WITH b AS (SELECT doc_id AS sample_id, CASE WHEN max(quality) = 1 THEN 'passed' ELSE 'failed' END AS was, CASE WHEN max(toxic) = 0 THEN 'passed' ELSE 'failed' END AS "is" FROM labels GROUP BY doc_id)
SELECT sample_id, was, "is", CASE WHEN was = 'passed' THEN 'regressed' ELSE 'improved' END AS change FROM b WHERE was <> "is" """)
def baseline_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples whose status differs between two runs, made of the two labels."""
    labels = read_table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("sample_id")).agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    status = lambda good: labels.select("sample_id", F.when(good, "passed").otherwise("failed").alias("status"))
    return quality.compare_with_baseline(status(F.col("q") == 1), status(F.col("t") == 0))


# Timings and reports

@query("""SELECT event_type, count(value) FILTER (WHERE value >= 0) AS n, min(value) FILTER (WHERE value >= 0) AS least, median(value) FILTER (WHERE value >= 0) AS median, quantile_disc(value, 0.95) FILTER (WHERE value >= 0) AS p95, max(value) FILTER (WHERE value >= 0) AS most FROM events GROUP BY event_type""")
def timing_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distribution of values by event type, with the nearest-rank 95th percentile."""
    return performance.timings(read_table(spark, sf_dir, "events"), "value", "event_type")


@query("""SELECT user_id, event_type, ts, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_type)) - epoch_us(ts) AS micros FROM events""")
def stage_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time from each event of a user to the next."""
    return performance.stage_durations(read_table(spark, sf_dir, "events"), "user_id", "event_type", "ts")


@query("""SELECT conv_id, sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY turn, text)) AS hash, count(*) AS n FROM conversations GROUP BY conv_id""")
def conversation_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content hash of each conversation."""
    return performance.ordered_hash(read_table(spark, sf_dir, "conversations"), "text", "turn", "conv_id")


@query("""WITH f AS (SELECT l_returnflag AS batch, CASE l_linestatus WHEN 'O' THEN 'ok' WHEN 'F' THEN CASE WHEN l_linenumber = 1 THEN 'failed' ELSE 'ok' END END AS outcome FROM lineitem),
s AS (SELECT batch, count(*) AS n_files, count(*) FILTER (WHERE outcome = 'ok') AS n_ok, count(*) FILTER (WHERE outcome = 'failed') AS n_failed, 0::BIGINT AS n_skipped, 0::BIGINT AS n_interrupted FROM f GROUP BY batch)
SELECT *, CASE WHEN n_failed > 0 AND n_ok > 0 THEN 'partial' WHEN n_failed > 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN n_failed > 0 THEN 10 ELSE 0 END AS exit_code FROM s""")
def batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch totals and status, with line items as files."""
    outcome = F.when(F.col("l_linestatus") == "O", "ok").when(F.col("l_linestatus") == "F", F.when(F.col("l_linenumber") == 1, "failed").otherwise("ok"))
    return reports.batch_summary(read_table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("batch"), outcome.alias("outcome")), "batch")


# Layout

_LAYOUT = LayoutOptions(expand=True)


@query(f"""WITH {adapters.FURNITURE_SQL}
SELECT a.doc, a.page, a.block_id, greatest(a.y1, coalesce(least(a.page_h, min(b.y0) - 1.0::DOUBLE), a.page_h)) AS "limit" FROM blocks a LEFT JOIN blocks b ON a.doc = b.doc AND a.page = b.page AND a.block_id <> b.block_id AND b.y0 >= a.y1 AND b.x0 < a.x1 AND b.x1 > a.x0
GROUP BY a.doc, a.page, a.block_id, a.y1, a.page_h""")
def expansion_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far down each block may grow."""
    return layout.lower_limits(_furniture(spark, sf_dir), _LAYOUT).select("doc", "page", "block_id", "limit")


@query(f"""WITH {adapters.FURNITURE_SQL}
SELECT a.doc, a.page, a.block_id, NOT EXISTS (SELECT 1 FROM blocks b WHERE a.doc = b.doc AND a.page = b.page AND a.block_id <> b.block_id AND a.x0 - 0.5 < b.x1 AND b.x0 < a.x1 + 0.5 AND a.y0 - 0.5 < b.y1 AND b.y0 < a.y1 + 0.5
  AND NOT (a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)) AS padded FROM blocks a""")
def redaction_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a block's redaction may be padded."""
    return layout.redaction_boxes(_furniture(spark, sf_dir), _LAYOUT).select("doc", "page", "block_id", "padded")


# Text in boxes

_SANS = FontMetrics()


def _width_sql(text: str) -> str:
    """The width of a text in thousandths of the font size."""
    quoted = lambda chars: "'" + chars.replace("'", "''") + "'"
    parts = [f"length({text}) * {_SANS.default}", f"(length({text}) - length(regexp_replace({text}, '{FULL_WIDTH}', '', 'g'))) * {_SANS.overrides - _SANS.default}"]
    return "(" + " + ".join([*parts, *(f"(length({text}) - length(translate({text}, {quoted(chars)}, ''))) * ({advance - _SANS.default})" for advance, chars in _SANS.groups().items())]) + ")::BIGINT"


def _measured_sql(text: str) -> str:
    """For each line of a text its words with their widths."""
    return rf"list_transform(string_split({text}, chr(10)), lambda line: list_transform(list_filter(regexp_split_to_array(line, '[ \t\r]+'), lambda w: w <> ''), lambda w: {{'text': w, 'width': {_width_sql('w')}}}))"


def _lines_sql(words: str, limit: str) -> str:
    """How many lines measured words make: a fold over words, and over the characters of words that are wider than a line."""
    piece = lambda width, space, fresh: f"{{'n': 1::BIGINT, 'at': -1::BIGINT, 'width': {width}::BIGINT, 'space': {space}::BIGINT, 'fresh': {fresh}}}"
    pieces = f"flatten(list_transform(l, lambda w: CASE WHEN w.width > {limit} THEN list_transform(string_split(w.text, ''), lambda c, k: {piece(_width_sql('c'), 0, 'k = 1')}) ELSE [{piece('w.width', _SANS.space, 'false')}] END))"
    stays = f"(a.at < 0 OR (NOT x.fresh AND a.at + x.space + x.width <= {limit}))"
    fold = f"list_reduce(list_prepend({piece(0, 0, 'false')}, {pieces}), lambda a, x: {{'n': a.n + CASE WHEN {stays} THEN 0 ELSE 1 END, 'at': CASE WHEN {stays} AND a.at >= 0 THEN a.at + x.space + x.width ELSE x.width END, 'width': 0::BIGINT, 'space': 0::BIGINT, 'fresh': false}})"
    return f"list_sum(list_transform({words}, lambda l: ({fold}).n))::BIGINT"


@query(f"""
WITH m AS (SELECT doc_id, {_measured_sql("coalesce(text, '')")} AS m FROM documents)
SELECT doc_id, {_lines_sql("m", "20000")} AS n_lines, len(list_filter(flatten(m), lambda w: w.width > 20000))::BIGINT AS n_broken, coalesce(list_sum(list_transform(flatten(m), lambda w: w.width)), 0)::BIGINT AS width FROM m""")
def typeset_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines each document has in a column of 200 points at 10 points, words wider than it, and the width of all words."""
    rows = read_table(spark, sf_dir, "documents").select("doc_id", typeset.measured_words(F.coalesce("text", F.lit("")), _SANS).alias("m"))
    n = typeset.line_count(F.col("m"), typeset.line_limit(F.lit(200.0), F.lit(10.0)), _SANS)
    return rows.select("doc_id", n.alias("n_lines"), F.size(F.filter(F.flatten("m"), lambda w: w["width"] > 20_000)).cast("long").alias("n_broken"), typeset.words_width(F.col("m")).alias("width"))


_FITS = lambda height: f"floor({height} / (size * 1.2::DOUBLE) + 1e-6) >= 1 AND total <= floor((x1 - x0) * 1000 / size + 1e-6) * floor({height} / (size * 1.2::DOUBLE) + 1e-6) AND n_lines <= floor({height} / (size * 1.2::DOUBLE) + 1e-6)"


@query(f"""WITH lim AS ({SQL["expansion_limits"]}), {adapters.FURNITURE_SQL},
t AS (SELECT b.doc, b.page, b.block_id, x0, x1, y0, y1, font, lim."limit" AS low, {_measured_sql("(text || left(text, ceil(length(text) / 2)::INT))")} AS m FROM blocks b JOIN lim ON b.doc = lim.doc AND b.page = lim.page AND b.block_id = lim.block_id),
s AS (SELECT * EXCLUDE (ladder), unnest(ladder) AS size, generate_subscripts(ladder, 1) AS k FROM (SELECT *, list_append(list_transform(range(0, ceil((font - 6) / 0.5)::INT), lambda i: font - 0.5::DOUBLE * i), 6.0::DOUBLE) AS ladder FROM t)),
n AS (SELECT *, coalesce(list_sum(list_transform(flatten(m), lambda w: w.width)), 0) AS total, {_lines_sql("m", "floor((x1 - x0) * 1000 / size + 1e-6)")} AS n_lines FROM s),
f AS (SELECT doc, page, block_id, any_value(font) AS font_first, any_value(low) > any_value(y1) + 1e-6 AS grows, max(k) AS steps, min(k) FILTER (WHERE {_FITS("(y1 - y0)")}) AS here, min(k) FILTER (WHERE {_FITS("(low - y0)")}) AS grown, arg_min(size, k) FILTER (WHERE {_FITS("(y1 - y0)")}) AS size_here, arg_min(size, k) FILTER (WHERE {_FITS("(low - y0)")}) AS size_grown FROM n GROUP BY doc, page, block_id),
g AS (SELECT *, coalesce(size_here, CASE WHEN grows THEN size_grown END) AS font_size, here IS NULL AND grows AND grown IS NOT NULL AS expanded FROM f)
SELECT doc, page, block_id, font_first, font_size, (coalesce(here, steps) + CASE WHEN here IS NULL AND grows THEN coalesce(grown, steps) ELSE 0 END)::BIGINT AS attempts, expanded, font_size IS NULL AS overflow,
  CASE WHEN font_size IS NULL THEN 'block ' || block_id || ' overflows at the least font' WHEN expanded THEN 'block ' || block_id || ' expanded downward' END AS warning FROM g""")
def layout_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Font sizes, expansion and overflow of blocks whose text grew by half."""
    blocks = _furniture(spark, sf_dir).withColumns({"translated": F.concat("text", F.left("text", F.ceil(F.length("text") / 2).cast("int"))), "sizes": F.array("font")})
    return layout.plan_layout(blocks, _LAYOUT)


CLIPPED = 20_000  # blocks of a task, about


@query(rf"""WITH {adapters.FURNITURE_SQL}, {adapters.WORDS_SQL},
c AS (SELECT doc, page, block_id, text, greatest(0, x0 - greatest(2.0::DOUBLE, font * 0.8::DOUBLE)) AS x0, greatest(0, y0 - greatest(2.0::DOUBLE, font * 0.8::DOUBLE)) AS y0, least(page_w, x1 + greatest(2.0::DOUBLE, font * 0.8::DOUBLE)) AS x1, least(page_h, y1 + greatest(2.0::DOUBLE, font * 0.8::DOUBLE)) AS y1 FROM blocks),
p AS (SELECT c.doc, c.page, c.block_id, string_agg(w.word, ' ' ORDER BY w.y0, w.x0, w.word) AS found FROM c JOIN words w ON c.doc = w.doc AND c.page = w.page AND w.x0 < c.x1 AND c.x0 < w.x1 AND w.y0 < c.y1 AND c.y0 < w.y1 GROUP BY ALL),
n AS (SELECT c.doc, coalesce(p.found, '') AS found, trim(regexp_replace(translate(c.text, '‐‑‒–—−（）', '------()'), '\s+', ' ', 'g')) AS expected FROM c LEFT JOIN p ON c.doc = p.doc AND c.page = p.page AND c.block_id = p.block_id)
SELECT doc, count(*) AS n_blocks, count(*) FILTER (WHERE contains(trim(regexp_replace(translate(found, '‐‑‒–—−（）', '------()'), '\s+', ' ', 'g')), expected)) AS n_verified, sum(length(found))::BIGINT AS chars FROM n GROUP BY doc""")
def clip_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each logical document's blocks, those whose text is found among the words that the page has in their place."""
    blocks = _stored_furniture(spark, sf_dir)
    # blocks are shuffled and words aren't; so many tasks that the words of one are sorted in memory
    blocks = blocks.repartition(max(spark.sparkContext.defaultParallelism, blocks.count() // CLIPPED + 1), "doc", "page")
    found = typeset.verified_clips(blocks, adapters.words(blocks), "text", "font")
    return found.groupBy("doc").agg(F.count("*").alias("n_blocks"), F.count_if("verified").alias("n_verified"), F.sum(F.length(F.coalesce("found", F.lit("")))).alias("chars"))


# Hashes


@query("SELECT doc_id, sha256(coalesce(text, '')) AS hash, strlen(coalesce(text, ''))::BIGINT AS bytes FROM documents")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content hash and size of each document."""
    content = F.coalesce("text", F.lit("")).cast("binary")
    return read_table(spark, sf_dir, "documents").select("doc_id", performance.content_hash(content).alias("hash"), F.octet_length(content).cast("long").alias("bytes"))


"""Chunks and their enrichment."""
from pyspark.sql import functions as F

from docquarry import fixed as V
from docquarry.functions.scan import with_segments
from docquarry.operators import chunks as K
from docquarry.operators import sections as T
from docquarry.registry.base import FILES, documents_meta, lit, pages, query, sql_any, sql_collapse, sql_rx, table
from docquarry.registry.documents import NORMAL, PARTS, sql_types
from docquarry.registry.sections import SECTIONS, atoms


def blocks_and_sections(spark, sf):
    a = atoms(spark, sf)
    return T.block_rows(a), T.section_rows(a).select("document_id", "section_seq", "title")


CELLS = lambda r: f"list_filter(list_transform(string_split(trim({r}, '|'), '|'), lambda c: trim(c)), lambda c: c != '')"
ROWS = f"""tb AS (SELECT bl.*, sec.title, {CELLS('lines[1]')} AS header,
  CASE WHEN len(lines) > 1 AND regexp_matches(lines[2], '^[-:| ]*$') THEN 2 ELSE 1 END AS skip FROM bl JOIN sec USING (document_id, section_seq) WHERE block_type = 'table'),
tr AS (SELECT *, i - skip AS row, {CELLS('lines[i]')} AS own FROM tb, unnest(range(skip + 1, len(lines) + 1)) AS t(i)),
trow AS (SELECT document_id, section_seq, block_no, row, page_start, page_end, concat('Table (', CASE WHEN title != '' THEN title ELSE 'Data' END, '): ',
  CASE WHEN len(header) > 0 THEN array_to_string(list_transform(range(1, least(len(header), len(own)) + 1), lambda j: concat(header[j], ' = ', own[j])), '; ')
  ELSE array_to_string(own, '; ') END, '.') AS text FROM tr WHERE len(own) > 0)"""


@query("k01_table_parent", f"WITH {SECTIONS} SELECT document_id, block_no, text FROM bl WHERE block_type = 'table'")
def k01(spark, sf):
    return K.chunk_units(atoms(spark, sf)).filter("chunk_type = 'table'").select("document_id", "block_no", "text")


@query("k02_table_rows", f"WITH {SECTIONS}, {ROWS} SELECT document_id, block_no, row, text FROM trow")
def k02(spark, sf):
    blocks, sections = blocks_and_sections(spark, sf)
    return blocks.filter("block_type = 'table'").join(sections, ["document_id", "section_seq"]).select(
        "document_id", "block_no", F.inline(K.table_row_texts(F.col("lines"), F.col("title"))))


# greedy packing as one list fold: L is the load, p the pack, o the packs so far
def sql_packs(lens, cap):
    return (f"list_reduce(list_transform({lens}, lambda x: {{'L': CAST(x AS BIGINT), 'p': CAST(0 AS BIGINT), 'o': CAST([] AS BIGINT[])}}), "
            f"lambda a, x: CASE WHEN a.L = 0 OR a.L + x.L > {cap} THEN {{'L': x.L + 1, 'p': a.p + 1, 'o': list_append(a.o, a.p + 1)}} "
            f"ELSE {{'L': a.L + x.L + 1, 'p': a.p, 'o': list_append(a.o, a.p)}} END, "
            f"{{'L': CAST(0 AS BIGINT), 'p': CAST(-1 AS BIGINT), 'o': CAST([] AS BIGINT[])}}).o")


BULLETS = f"""bp AS (SELECT document_id, section_seq, block_no, page_start, page_end, lines, {sql_packs('list_transform(lines, lambda l: length(l))', 1500)} AS packs
  FROM bl WHERE block_type = 'bullet_group'),
bk AS (SELECT document_id, section_seq, block_no, pack, any_value(page_start) AS page_start, any_value(page_end) AS page_end,
  string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS bullet_count FROM (
  SELECT *, lines[i] AS line, packs[i] AS pack FROM bp, unnest(range(1, len(lines) + 1)) AS t(i)) GROUP BY 1, 2, 3, 4)"""


@query("k03_bullet_packing", f"WITH {SECTIONS}, {BULLETS} SELECT document_id, block_no, pack, text, bullet_count FROM bk")
def k03(spark, sf):
    return K.bullet_packs(atoms(spark, sf)).select("document_id", "block_no", "pack", "text", "bullet_count")


# RE2 has no look-around: mark the breaks, then split at the marks
MARKED = r"regexp_replace(regexp_replace(text, '([.!?])\s+([A-Z0-9(])', '\1¦\2', 'g'), '([.!?])\s+([A-Z0-9(])', '\1¦\2', 'g')"
SENTENCES = f"""sn AS (SELECT document_id, section_seq, run_no, block_no, page_start, page_end, i AS sent_no, trim(l[i]) AS sentence FROM (
  SELECT *, string_split({MARKED}, '¦') AS l FROM bl WHERE block_type = 'paragraph'), unnest(range(1, len(l) + 1)) AS t(i) WHERE trim(l[i]) != '')"""


@query("k04_sentence_split", f"WITH {SECTIONS}, {SENTENCES} SELECT document_id, block_no, sent_no, sentence FROM sn")
def k04(spark, sf):
    blocks = T.block_rows(atoms(spark, sf)).filter("block_type = 'paragraph'")
    return blocks.select("document_id", "block_no", F.posexplode(K.sentences(F.element_at("lines", 1))).alias("n", "sentence")).select(
        "document_id", "block_no", (F.col("n") + 1).alias("sent_no"), "sentence")


PACKS = f"""{SENTENCES},
rn AS (SELECT document_id, section_seq, run_no, min(block_no) AS first_no, list(sentence ORDER BY block_no, sent_no) AS ss, list(block_no ORDER BY block_no, sent_no) AS bs,
  list(page_start ORDER BY block_no, sent_no) AS ps, list(page_end ORDER BY block_no, sent_no) AS pe FROM sn GROUP BY 1, 2, 3),
rp AS (SELECT *, {sql_packs('list_transform(ss, lambda s: length(s))', 1000)} AS packs FROM rn),
pk AS (SELECT document_id, section_seq, run_no, pack, any_value(first_no) AS first_no, string_agg(s, ' ' ORDER BY i) AS text, arg_min(p1, i) AS page_start, arg_max(p2, i) AS page_end
  FROM (SELECT *, ss[i] AS s, ps[i] AS p1, pe[i] AS p2, packs[i] AS pack FROM rp, unnest(range(1, len(ss) + 1)) AS t(i)) GROUP BY 1, 2, 3, 4)"""


@query("k05_sentence_packing", f"WITH {SECTIONS}, {PACKS} SELECT document_id, run_no, pack, text, page_start, page_end FROM pk")
def k05(spark, sf):
    return K.sentence_packs(T.block_rows(atoms(spark, sf))).select("document_id", "run_no", "pack", "text", "page_start", "page_end")


# a fold over the packs of a run, as the rule is told: into the last kept pack if short and if both fit
MERGED = f"""{PACKS},
pr AS (SELECT document_id, section_seq, run_no, any_value(first_no) AS first_no, list_reduce(list([{{'t': text, 's': page_start, 'e': page_end}}] ORDER BY pack),
  lambda a, x: CASE WHEN length(x[1].t) < 120 AND length(a[-1].t) + length(x[1].t) <= 1400
    THEN list_append(a[:-2], {{'t': concat(a[-1].t, ' ', x[1].t), 's': a[-1].s, 'e': greatest(a[-1].e, x[1].e)}})
    ELSE list_append(a, x[1]) END) AS m FROM pk GROUP BY 1, 2, 3),
mg AS (SELECT document_id, section_seq, run_no, first_no, i - 1 AS idx, m[i].t AS text, m[i].s AS page_start, m[i].e AS page_end FROM pr, unnest(range(1, len(m) + 1)) AS t(i))"""


@query("k06_short_pack_merge", f"WITH {SECTIONS}, {MERGED} SELECT document_id, run_no, idx, text, page_start, page_end FROM mg")
def k06(spark, sf):
    packs = K.sentence_packs(T.block_rows(atoms(spark, sf)))
    return K.merge_short_packs(packs).select("document_id", "run_no", "idx", "text", "page_start", "page_end")


# the chunk table
UNITS = f"""{SECTIONS}, {ROWS}, {BULLETS}, {MERGED},
un AS (SELECT document_id, section_seq, block_no, 0 AS sub, 'table' AS chunk_type, text, NULL AS bullet_count, page_start, page_end FROM bl WHERE block_type = 'table'
  UNION ALL SELECT document_id, section_seq, block_no, pack, 'bullet_group', text, bullet_count, page_start, page_end FROM bk
  UNION ALL SELECT document_id, section_seq, first_no, idx, 'paragraph', text, NULL, page_start, page_end FROM mg)"""
META = f"""{FILES}, {PARTS}, dm AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, name AS source, relative_path, coalesce(upper(trim(q[1])), '') AS carrier,
  coalesce({NORMAL.format('q[2]')}, '') AS line_of_business, coalesce(q[3], '') AS product, coalesce(q[4], '') AS sub_product, stem AS document_name,
  {sql_types(lambda k, p: lit(k), lit(V.DEFAULT_TYPE))} AS document_type, {sql_types(lambda k, p: str(p), V.DEFAULT_PRIORITY)} AS document_priority FROM fp)"""
LABEL = f"""CASE WHEN line_of_business != '' THEN line_of_business WHEN sub_product != '' THEN sub_product WHEN product != '' THEN product
  ELSE trim(replace(regexp_replace(document_name, {lit(V.NAME_TAIL)}, '', 'i'), '_', ' ')) END"""
CHUNK_TABLE = f"""{META}, {UNITS},
cj AS (SELECT un.*, dm.* EXCLUDE (document_id), sec.heading_path, sec.title AS section_title, sec.section_number, sec.level AS section_level, sec.heading_confidence,
  block_no - first_block AS bi, {LABEL} AS label FROM un JOIN sec USING (document_id, section_seq) JOIN dm USING (document_id)),
ci AS (SELECT *, md5(concat_ws('_', document_id, {sql_collapse('lower(heading_path)')},
  CASE chunk_type WHEN 'bullet_group' THEN concat(bi, '_', sub) WHEN 'paragraph' THEN CAST(bi + sub AS VARCHAR) ELSE CAST(bi AS VARCHAR) END, {sql_collapse('lower(text)')})) AS cid FROM cj),
ck0 AS (SELECT * EXCLUDE (cid), cid AS chunk_id, '' AS parent_chunk_id, 0 AS row FROM ci
  UNION ALL BY NAME SELECT ci.* EXCLUDE (cid, text, chunk_type, page_start, page_end), 'table_row' AS chunk_type, concat(cid, '_row_', trow.row) AS chunk_id, cid AS parent_chunk_id, trow.row, trow.text,
    trow.page_start, trow.page_end FROM ci JOIN trow ON ci.document_id = trow.document_id AND ci.block_no = trow.block_no AND ci.chunk_type = 'table'),
ck1 AS (SELECT *, concat_ws(' | ', CASE WHEN carrier != '' AND chunk_type != 'table_row' THEN concat('Carrier: ', carrier) END,
  CASE WHEN label != '' AND chunk_type != 'table_row' THEN concat('Product: ', label) END, CASE WHEN heading_path != '' THEN concat('Heading: ', heading_path) END) AS ctx FROM ck0),
ck AS (SELECT *, CASE WHEN ctx = '' THEN text ELSE concat('[Context: ', ctx, '] ', chr(10), chr(10), text) END AS page_content,
  coalesce(lag(chunk_id) OVER wd, '') AS previous_chunk_id, coalesce(lead(chunk_id) OVER wd, '') AS next_chunk_id, row_number() OVER wd - 1 AS local_index,
  row_number() OVER (ORDER BY relative_path, block_no, sub, row) - 1 AS chunk_index FROM ck1 WINDOW wd AS (PARTITION BY document_id ORDER BY block_no, sub, row))"""


def built(spark, sf, *columns, where="true"):
    """These columns of the chunk table, which is made and written in shares of the documents."""
    n = K.shares(table(spark, sf, "documents").select("text"))
    return K.chunk_shares(pages(spark, sf), documents_meta(spark, sf), n, lambda c: c.filter(where).select(*columns))


@query("k07_chunk_id", f"WITH {CHUNK_TABLE} SELECT document_id, chunk_type, chunk_id, parent_chunk_id FROM ck")
def k07(spark, sf):
    return built(spark, sf, "document_id", "chunk_type", "chunk_id", "parent_chunk_id")


@query("k08_context_prefix", f"WITH {CHUNK_TABLE} SELECT chunk_id, page_content FROM ck")
def k08(spark, sf):
    return built(spark, sf, "chunk_id", "page_content")


@query("k09_section_orchestration", f"WITH {CHUNK_TABLE} SELECT document_id, section_seq, local_index, chunk_type, text, bullet_count, page_start, page_end FROM ck")
def k09(spark, sf):
    return built(spark, sf, "document_id", "section_seq", "local_index", "chunk_type", "text",
                 F.when(F.col("chunk_type") != "table_row", F.col("bullet_count")).alias("bullet_count"), "page_start", "page_end")


@query("k10_links_and_index", f"WITH {CHUNK_TABLE} SELECT chunk_id, previous_chunk_id, next_chunk_id, chunk_index FROM ck")
def k10(spark, sf):
    # only what the index reads is written, not the enriched chunks
    linked = built(spark, sf, "document_id", "relative_path", "local_index", "chunk_id", "previous_chunk_id", "next_chunk_id")
    return K.index_chunks(linked, stored=True).select("chunk_id", "previous_chunk_id", "next_chunk_id", "chunk_index")


@query("k11_retrieval_text", f"""WITH {CHUNK_TABLE} SELECT chunk_id, concat_ws(' ', CASE WHEN section_number != '' THEN section_number END,
  CASE WHEN section_title != '' THEN section_title END, CASE WHEN heading_path != '' THEN heading_path END, page_content) AS retrieval_text FROM ck""")
def k11(spark, sf):
    return built(spark, sf, "chunk_id", "retrieval_text")


SPLIT = lambda size, over: f"""ww AS (SELECT doc_id, string_split({sql_collapse('text')}, ' ') AS ws FROM documents WHERE trim(text) != ''),
sw AS (SELECT doc_id, s // {size - over} AS window, concat('[Section: General] ', array_to_string(ws[s + 1:s + {size}], ' ')) AS chunk_text
  FROM ww, unnest(range(0, greatest(len(ws) - {over}, 1), {size - over})) AS t(s))"""


@query("k12_token_windows", f"WITH {SPLIT(800, 150)} SELECT doc_id, \"window\", chunk_text, sha256({sql_collapse('lower(chunk_text)')}) AS chunk_id FROM sw")
def k12(spark, sf):
    return K.split_tokens(table(spark, sf, "documents").select("doc_id", "text", F.lit("General").alias("heading"))).drop("heading")


# '# ' in front of some lines makes a document of sections
HASHES = "array_join(transform(split(text, chr(10)), (x, i) -> concat(CASE (doc_id + i + 1) % 5 WHEN 0 THEN '## ' WHEN 2 THEN '  #### ' ELSE '' END, x)), chr(10))"
SQL_HASHES = "array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: concat(CASE (doc_id + i) % 5 WHEN 0 THEN '## ' WHEN 2 THEN '  #### ' ELSE '' END, x)), chr(10))"
PIECES = lambda body, size, over: f"list_transform(range(0, greatest(length({body}) - {over}, 1), {size - over}), lambda s: substr({body}, s + 1, {size}))"
MARKDOWN = rf"""hl AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM (SELECT doc_id, string_split({SQL_HASHES}, chr(10)) AS l FROM documents)),
hg AS (SELECT *, sum(CASE WHEN regexp_matches(trim(line), '^#{{1,4}} ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS g FROM hl),
hc AS (SELECT doc_id, g, trim(string_agg(line, chr(10) ORDER BY n), concat(chr(10), ' ')) AS p FROM hg GROUP BY doc_id, g),
hb AS (SELECT *, string_split(p, chr(10))[1] AS first, regexp_matches(string_split(p, chr(10))[1], '^#{{1,4}} \s*\S') AS headed FROM hc WHERE p != ''),
hx AS (SELECT doc_id, g, CASE WHEN length(p) > 1800 THEN list_transform(
    CASE WHEN headed THEN {PIECES('substr(p, length(first) + 2)', 1500, 250)} ELSE {PIECES('p', 1500, 250)} END,
    lambda w: trim(concat(CASE WHEN headed THEN concat(first, chr(10)) ELSE '' END, w), concat(chr(10), ' '))) ELSE [p] END AS parts FROM hb),
hp AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g, j) - 1 AS parent_no, parts[j] AS parent_text FROM hx, unnest(range(1, len(parts) + 1)) AS t(j))"""


def marked(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("page"), F.expr(HASHES).alias("text"))


@query("k13_parent_child_split", f"""WITH {MARKDOWN} SELECT CAST(doc_id AS VARCHAR) AS document_id, parent_no, s // 275 AS child_no, substr(parent_text, s + 1, 350) AS child_text, parent_text,
  row_number() OVER o - 1 AS chunk_index, concat(doc_id, '_', row_number() OVER o - 1) AS chunk_id
  FROM hp, unnest(range(0, greatest(length(parent_text) - 75, 1), 275)) AS t(s) WINDOW o AS (PARTITION BY doc_id ORDER BY parent_no, s)""")
def k13(spark, sf):
    return K.parent_children(with_segments(marked(spark, sf))).drop("page")


@query("k14_markdown_heading_split", f"WITH {MARKDOWN} SELECT CAST(doc_id AS VARCHAR) AS document_id, parent_no, parent_text FROM hp")
def k14(spark, sf):
    return marked(spark, sf).select("document_id", F.posexplode(K.markdown_sections(F.col("text"))).alias("parent_no", "parent_text"))


CANDIDATE = rf"""length(line) BETWEEN 4 AND 80 AND NOT regexp_matches(line, '^[\d\.\s]+$') AND NOT regexp_matches(line, '^[^\p{{L}}\p{{N}}_\s]+$')
  AND NOT {sql_any('lower(line)', V.CARRY_NOISE)} AND ({' OR '.join(f"starts_with(lower(line), {lit(p)})" for p in V.CARRY_PREFIXES)} OR {sql_any('lower(line)', V.CARRY_KEYWORDS)})"""


@query("k15_heading_carry", f"""WITH {SECTIONS}, own AS (SELECT document_id, page, arg_max(line, line_no) FILTER (WHERE {CANDIDATE}) AS h FROM tl GROUP BY 1, 2),
pg AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS document_id, (n - 1) // 6 + 1 AS page FROM raw)
SELECT document_id, page, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'General') AS heading
FROM pg LEFT JOIN own USING (document_id, page)""")
def k15(spark, sf):
    return K.carry_headings(with_segments(pages(spark, sf))).select("document_id", "page", "heading")


@query("k16_empty_document", """SELECT doc_id, CASE WHEN trim(text, concat(' ', chr(10))) = '' THEN concat('This document ''f', doc_id, ''' has no extractable text; placeholder chunk.') ELSE text END AS text
FROM (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, concat(' ', chr(10), ' ') FROM documents WHERE doc_id % 4 = 0)""")
def k16(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "text")  # and blank documents besides
    df = df.union(df.filter("doc_id % 4 = 0").select("doc_id", F.lit(" \n ")))
    return df.select("doc_id", K.fill_empty_document(F.col("text"), F.concat(F.lit("f"), "doc_id")).alias("text"))


# --- enrichment --------------------------------------------------------------------
B0, B1 = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
DURATION = B0 + V.HAS_DURATION.removeprefix(r"\b").removesuffix(r"\b") + B1


def sql_flags(x):
    return (f"{sql_rx(x, V.HAS_NUMBER)} AS contains_numbers, {sql_rx(x, V.HAS_PERCENT)} AS contains_percentage, "
            f"{sql_rx(x, DURATION, True)} AS contains_duration, {sql_rx(x, V.HAS_MONEY, True)} AS contains_money")


REFS = rf"list_transform(regexp_extract_all(text, {lit(V.REFERENCE)}, 1, 'i'), lambda r: {sql_collapse('r')})"
KW = lambda kind: f"({sql_any('path', V.SEMANTIC_KEYWORDS[kind])} OR {sql_any('low', V.SEMANTIC_KEYWORDS[kind])})"
ASKS = B0 + r"(what|how|why|when|who|where|is\s+there|can\s+i)" + B1.replace("$|", "") + r".*\?"
ASKS = r"(^|[^\p{L}\p{N}_])(what|how|why|when|who|where|is\s+there|can\s+i)(\?|[^\p{L}\p{N}_\n].*\?)"
TYPE = f"""CASE WHEN chunk_type IN ('table', 'table_row') OR (contains(text, '[Context: ') AND contains(text, '| Col ')) THEN 'table'
  WHEN {KW('faq')} OR {sql_rx('low', ASKS)} THEN 'faq' WHEN {KW('exclusion')} THEN 'exclusion' WHEN {KW('waiting_period')} THEN 'waiting_period'
  WHEN {KW('claim_process')} OR contains(path, 'claim') THEN 'claim_process' WHEN {KW('premium')} THEN 'premium' WHEN {KW('eligibility')} THEN 'eligibility'
  WHEN {KW('hospital_network')} THEN 'hospital_network' WHEN contains(path, 'definition') OR {sql_rx('text', V.DEFINITION)} THEN 'definition'
  WHEN {KW('benefit')} THEN 'benefit' WHEN {KW('coverage')} THEN 'coverage' WHEN {KW('contact')} THEN 'contact' ELSE 'general' END"""
ENRICHED = f"en AS (SELECT *, {REFS} AS refs, lower(text) AS low, lower(heading_path) AS path FROM ck)"
REFERENCES = "array_to_string(list_filter(refs, lambda r, i: list_position(list_transform(refs, lambda z: lower(z)), lower(r)) = i), '|')"


@query("m01_content_flags", f"WITH {CHUNK_TABLE} SELECT chunk_id, {sql_flags('text')} FROM ck")
def m01(spark, sf):
    return built(spark, sf, "chunk_id", "contains_numbers", "contains_percentage", "contains_duration", "contains_money")


@query("m02_references", f'WITH {CHUNK_TABLE}, {ENRICHED} SELECT chunk_id, {REFERENCES} AS "references" FROM en')
def m02(spark, sf):
    return built(spark, sf, "chunk_id", "references")


@query("m03_semantic_type", f"WITH {CHUNK_TABLE}, {ENRICHED} SELECT chunk_id, {TYPE} AS semantic_type FROM en")
def m03(spark, sf):
    return built(spark, sf, "chunk_id", "semantic_type")


@query("m04_enriched_chunks", f"""WITH {CHUNK_TABLE}, {ENRICHED} SELECT chunk_id, document_id, chunk_type, source, relative_path, document_type, document_priority, section_number,
  section_title, section_level, heading_path, heading_confidence, page_start, page_end, carrier, line_of_business, product, sub_product,
  chunk_type IN ('table', 'table_row') AS contains_table, chunk_type = 'bullet_group' AS contains_bullets, {sql_flags('text')}, {REFERENCES} AS "references", {TYPE} AS semantic_type FROM en""")
def m04(spark, sf):
    return built(
        spark, sf, "chunk_id", "document_id", "chunk_type", "source", "relative_path", "document_type", "document_priority", "section_number", "section_title",
        "section_level", "heading_path", "heading_confidence", "page_start", "page_end", "carrier", "line_of_business", "product", "sub_product",
        "contains_table", "contains_bullets", "contains_numbers", "contains_percentage", "contains_duration", "contains_money", "references", "semantic_type")

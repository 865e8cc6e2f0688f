"""The catalogue's results as DuckDB SQL over the same tables."""

from __future__ import annotations

from quern.functions import registry as R
from quern.functions.plan import OPTION_OF, PACKER_NAME
from quern.operators.codecs import PACKERS
from quern.operators.repack import READABLE
from quern.plans.catalog import DOUBLED, KINDS, NAMES, SIZES, STARTS


def text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def listed(items) -> str:
    return "[" + ", ".join(map(text, items)) + "]"


def values(table: dict[str, str]) -> str:
    return "(VALUES " + ", ".join(f"({text(k)}, {text(v)})" for k, v in table.items()) + ")"


def blob(data: bytes) -> str:
    return f"unhex('{data.hex()}')"


PATHS = f"""names AS (SELECT doc_id, octet_length(encode(text))::BIGINT AS size,
  {listed(["data", "Docs", "node_modules", "venv", "a" + chr(92) + "b"])}[doc_id % 5 + 1] || '/' || source || '/File' || doc_id ||
  CASE WHEN {listed(NAMES)}[doc_id % {len(NAMES)} + 1] = '' THEN '' ELSE '.' || {listed(NAMES)}[doc_id % {len(NAMES)} + 1] END AS path FROM documents),
based AS (SELECT *, lower(split_part(replace(path, chr(92), '/'), '/', -1)) AS name FROM names),
exts AS (SELECT *, CASE WHEN contains(name, '.') THEN split_part(name, '.', -1) ELSE '' END AS ext,
  nullif(regexp_extract(name, '\\.(tar\\.(lzma|lz4|zst|bz2|gz|xz|br|lzo|lz|z))$', 1), '') AS compound FROM based),
known AS (SELECT e.*, f.v AS special, a.v AS alias,
  coalesce(f.v, CASE WHEN list_contains({listed(R.ARCHIVES)}, ext) THEN 'zip' END) AS family0, list_contains({listed(R.STANDALONE)}, ext) AS standalone
  FROM exts e LEFT JOIN {values(R.FAMILY_OF)} f(k, v) ON f.k = e.ext LEFT JOIN {values(R.ALIAS_OF)} a(k, v) ON a.k = e.ext),
kinds AS (SELECT *, CASE WHEN compound IS NOT NULL THEN compound WHEN family0 IS NOT NULL OR standalone THEN ext END AS key,
  CASE WHEN compound IS NOT NULL THEN compound WHEN family0 IS NOT NULL THEN family0 WHEN standalone THEN 'standalone' END AS family,
  CASE WHEN compound IS NULL AND family0 IS NULL AND standalone THEN coalesce(alias, ext) END AS packer FROM known),
keyed AS (SELECT *, list_filter([compound, CASE WHEN compound IS NOT NULL THEN split_part(compound, '.', -1) END, nullif(ext, ''), special, alias], lambda x: x IS NOT NULL) AS raw FROM kinds),
keys AS (SELECT *, list_filter(raw, lambda x, i: list_position(raw, x) = i) AS keys FROM keyed)"""

ASKED = f"""{PATHS}, asked AS (SELECT doc_id, path, size, packer, key, family, doc_id % 3 = 0 AS lossy, CASE WHEN doc_id % 4 = 1 THEN (doc_id % 100 + 1)::INT END AS quality,
  [NULL, '/Ebook', 'screen', 'ultra'][doc_id // 2 % 4 + 1] AS profile, [NULL, 'high', 'low', NULL][doc_id // 3 % 4 + 1] AS png, doc_id % 2 = 0 AS ultra, doc_id % 7 < 3 AS keep, doc_id % 5 <> 0 AS convert,
  [NULL, '0', '1.5KB', '10MB'][doc_id % 4 + 1] AS "limit" FROM kinds)"""

OUTCOMES = """o AS (SELECT doc_id, source, 'f' || doc_id AS path, octet_length(encode(text))::BIGINT AS insize,
  CASE doc_id % 10 WHEN 0 THEN octet_length(encode(text)) WHEN 1 THEN octet_length(encode(text)) + 7 WHEN 2 THEN 0 WHEN 3 THEN NULL
  ELSE trunc((octet_length(encode(text)) * (doc_id % 10 + 85))::DOUBLE / 100) END::BIGINT AS outsize, doc_id % 13 <> 0 AS valid FROM documents),
s AS (SELECT *, CASE WHEN insize > 0 THEN (insize - outsize) * 100.0::DOUBLE / insize ELSE 0.0::DOUBLE END AS share, coalesce(outsize, 0) > 0 AND valid AS made FROM o)"""


def decided(reject: str, replaced: str = "true") -> str:
    return f"""d AS (SELECT *, CASE WHEN made THEN insize END AS i, CASE WHEN made THEN CASE WHEN {reject} THEN insize ELSE outsize END END AS u,
  CASE WHEN made THEN CASE WHEN {reject} THEN 0.0::DOUBLE ELSE share END END AS p, CASE WHEN made THEN NOT ({reject}) AND {replaced} END AS r FROM s)"""


RESULTS = f"""{OUTCOMES}, {decided("outsize >= insize")}, r AS (SELECT doc_id, source, path, CASE WHEN doc_id % 17 = 0 THEN 'skipped' ELSE 'processed' END AS status, coalesce(i, insize) AS insize,
  coalesce(u, insize) AS outsize, coalesce(p, 0.0::DOUBLE) AS savings_pct FROM d)"""

PCT = "CASE WHEN {i} > 0 THEN ({i} - {o}) * 100.0::DOUBLE / {i} ELSE 0.0::DOUBLE END"

HEADER = "h[1:32]"


def _any(*needles: bytes) -> str:
    return "(" + " OR ".join(f"starts_with({HEADER}, '{n.hex().upper()}')" for n in needles) + ")"


def _holds(needle: bytes) -> str:
    return f"regexp_matches({HEADER}, '^(..)*{needle.hex().upper()}')"


STRIPPED = f"regexp_replace({HEADER}, '^(09|0A|0B|0C|0D|20)+', '')"
SIZE = "n"
VERIFY = "CASE WHEN " + SIZE + " = 0 THEN false " + " ".join(f"WHEN kind = {text(k)} THEN starts_with(h, '{v.hex().upper()}')" for k, v in R.PREFIXES.items()) + f"""
  WHEN kind = 'tif' THEN {_any(b"II", b"MM")} WHEN kind = 'webp' THEN {_any(b"RIFF")} WHEN kind = 'mkv' THEN {_any(bytes.fromhex("1a45dfa3"))}
  WHEN kind = 'xml' THEN starts_with({STRIPPED}, '3C') OR {_any(bytes.fromhex("efbbbf3c"))}
  WHEN kind = 'json' THEN regexp_matches(regexp_replace({STRIPPED}, '^(EF|BB|BF)+', ''), '^(7B|5B)')
  WHEN kind = 'pnm' THEN {_any(b"P1", b"P2", b"P3", b"P4", b"P5", b"P6")} WHEN kind = 'pcx' THEN {_any(bytes([10]))} WHEN kind = 'ts' THEN {_any(b"G")}
  WHEN kind = 'jxl' THEN {_any(bytes.fromhex("ff0a"))} OR {_holds(b"JXL")} WHEN kind = 'jp2' THEN {_holds(b"jP")} OR {_holds(b"ftypjp")} OR {_any(bytes.fromhex("ff4f"))}
  WHEN kind = 'nc' THEN {_any(b"CDF", bytes.fromhex("89484446"))} WHEN kind = 'mp3' THEN {_any(b"ID3")} OR regexp_matches({HEADER}, '^FF[EF]')
  WHEN kind = 'avif' THEN {_holds(b"ftyp")} WHEN kind = 'mp4' THEN {_holds(b"ftyp")} OR {SIZE} > 32 WHEN kind = 'tga' THEN {SIZE} > 18
  WHEN kind = 'lzma' THEN {SIZE} > 8 WHEN kind = 'wv' THEN {SIZE} > 16 WHEN kind = 'arrow' THEN {_any(b"ARROW1", b"FEA1")} OR {SIZE} >= 8 ELSE true END"""

CONTENTS = f"""c AS (SELECT doc_id, {listed(KINDS)}[floor(doc_id / 3)::BIGINT % {len(KINDS)} + 1] AS kind,
  [{", ".join(map(blob, STARTS))}][doc_id % {len(STARTS)} + 1] || CASE WHEN doc_id % 7 = 0 THEN ''::BLOB ELSE encode(text) END AS content FROM documents),
h AS (SELECT doc_id, kind, hex(content) AS h, octet_length(content) AS n FROM c)"""

FILTER = ["docx", "gz", "jpg", "xml", "zip", "tar.xz"]
SHOWN = "CASE WHEN ext <> '' THEN ext ELSE array_to_string(keys, ',') END"
XML = r"""'<part>' || chr(10) || '  <key>' || p_partkey || '</key>' || chr(13) || chr(10) || chr(9) || '<name> ' || p_name || ' </name> <size>' || p_size || '</size>' || chr(10) || chr(10) || '</part>'"""
XML_OUT = f"regexp_replace({XML}, '>\\s*[\\r\\n][ \\t\\r\\n]*<', '><', 'g')"
ARCHIVES = "SELECT source || '/' || (doc_id // 500) || '.{ext}' AS archive, count(*) AS members, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS bytes FROM documents GROUP BY 1"
SHOW = "CASE " + " ".join(f"WHEN size / {1024 ** k}::DOUBLE < 1024 THEN printf('%.2f {u}', size / {1024 ** k}::DOUBLE)" for k, u in enumerate(("B", "KB", "MB", "GB", "TB"))) + f" ELSE printf('%.2f PB', size / {1024 ** 5}::DOUBLE) END"
PARSED = dict(zip(SIZES, (100, 1024, 1536, 2 << 30, 0, 1, 3 << 40, 1 << 18, 7), strict=True))


def oracle_sql() -> dict[str, str]:
    found = {
        "identify_kind": f"WITH {PATHS} SELECT doc_id, name, ext, compound, key, family, packer, family <> 'standalone' AS is_archive, compound IS NOT NULL OR family0 IS NOT NULL OR standalone AS supported FROM kinds",
        "family_counts": f"WITH {PATHS} SELECT coalesce(family, 'unsupported') AS family, count(*) AS files, sum(size)::BIGINT AS bytes FROM kinds GROUP BY 1",
        "ext_key_lists": f"WITH {PATHS} SELECT doc_id, array_to_string(keys, ',') AS keys FROM keys",
        "filter_reasons": f"""WITH {PATHS}, why AS (SELECT doc_id, CASE WHEN NOT list_has_any(keys, {listed(FILTER)}) THEN 'Extension ''' || {SHOWN} || ''' not in include list'
  WHEN list_has_any(keys, ['kml', 'tgz']) THEN 'Extension ''' || {SHOWN} || ''' in exclude list' WHEN size < 500 THEN 'File size ' || size || ' < min_size 500'
  WHEN size > 20000 THEN 'File size ' || size || ' > max_size 20000' ELSE '' END AS reason FROM keys) SELECT doc_id, reason, reason = '' AS keep FROM why""",
        "dir_prune": f"WITH {PATHS} SELECT doc_id, list_has_any(split(replace(path, chr(92), '/'), '/')[:-2], {listed([*R.EXCLUDED_DIRS, 'src3'])}) AS pruned, ext = 'zip' AS plain_zip FROM exts",
        "category_gate": f"""WITH {PATHS} SELECT coalesce(c.v, 'none') AS category, count(*) AS files, count(*) FILTER (WHERE c.v IS NULL OR c.v NOT IN ('image', 'audio', 'video')) AS without_media
  FROM kinds LEFT JOIN {values(R.CATEGORY_OF)} c(k, v) ON c.k = packer GROUP BY 1""",
        "magic_verify": f"WITH {CONTENTS} SELECT doc_id, kind, {VERIFY} AS valid FROM h",
        "tar_header": "SELECT doc_id, doc_id % 3 = 0 AS is_tar FROM documents",
        "json_minify_savings": f"""WITH j AS (SELECT event_type, strlen(props)::BIGINT AS i, strlen(json(props)::VARCHAR)::BIGINT AS o FROM events), k AS (SELECT event_type, i, CASE WHEN o >= i THEN i ELSE o END AS o FROM j)
  SELECT *, insize - outsize AS saved, {PCT.format(i="insize", o="outsize")} AS pct FROM (SELECT event_type, count(*) AS files, sum(i)::BIGINT AS insize, sum(o)::BIGINT AS outsize FROM k GROUP BY 1)""",
        "json_minify_text": "SELECT event_id, json(props)::VARCHAR AS text FROM events",
        "xml_minify": f"SELECT p_partkey, {XML_OUT} AS packed, {XML_OUT} AS minified FROM part",
        "data_uri_extract": """WITH k AS (SELECT doc_id, ['png', 'jpeg', 'svg+xml', 'webp'][doc_id % 4 + 1] AS subtype, encode(text) AS body FROM documents),
  u AS (SELECT * FROM k WHERE subtype <> 'svg+xml' UNION ALL SELECT doc_id, 'gif', 'GIF89a'::BLOB FROM k)
  SELECT doc_id, subtype, octet_length(body)::BIGINT AS bytes, lower(hex(body)) AS data FROM u""",
        "commit_decision": f"WITH {OUTCOMES}, {decided('outsize >= insize')} SELECT doc_id, i AS insize, u AS outsize, p AS savings_pct, r AS replaced FROM d",
        "min_savings": f"WITH {OUTCOMES}, {decided('share < 9.0')} SELECT doc_id, i AS insize, u AS outsize, p AS savings_pct, r AS replaced FROM d",
        "dryrun_vs_real": f"WITH {OUTCOMES}, {decided('outsize >= insize')} SELECT true AS same_size, false AS dry, coalesce(r, false) AS real, count(*) AS files FROM d GROUP BY 1, 2, 3",
        "best_of_three": """WITH b AS (SELECT doc_id, octet_length(encode(text))::BIGINT AS n FROM documents),
  c AS (SELECT doc_id, 0 AS ordinal, 'first' AS tool, n - doc_id % 3 AS size FROM b UNION ALL SELECT doc_id, 1, 'second', n - doc_id % 5 FROM b WHERE doc_id % 4 <> 0 UNION ALL SELECT doc_id, 2, 'third', n - doc_id % 2 FROM b)
  SELECT doc_id, size, ordinal, tool FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY size, ordinal) = 1""",
        "extract_guard": f"""WITH g AS (SELECT doc_id, octet_length(encode(text))::BIGINT AS o, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE octet_length(encode(text)) * (doc_id % 140) END AS u FROM documents)
  SELECT doc_id, coalesce(u > {R.MAX_EXTRACT_BYTES} OR (o > 0 AND u > o * 100.0::DOUBLE), false) AS by_default, coalesce(u > 100000 OR (o > 0 AND u > o * 50.0::DOUBLE), false) AS strict, false AS off FROM g""",
        "bulk_totals": f"""WITH {RESULTS}, t AS (SELECT count(*) FILTER (WHERE status <> 'skipped') AS files_processed, 0::BIGINT AS files_failed, count(*) FILTER (WHERE status = 'skipped') AS files_skipped,
  sum(insize) FILTER (WHERE status <> 'skipped')::BIGINT AS total_original_size, sum(outsize) FILTER (WHERE status <> 'skipped')::BIGINT AS total_final_size FROM r)
  SELECT *, total_original_size - total_final_size AS total_saved, {PCT.format(i="total_original_size", o="total_final_size")} AS percent_saved FROM t""",
        "container_rollup": f"WITH {RESULTS} SELECT source, count(*) AS inner_count, sum(insize)::BIGINT AS inner_insize, sum(outsize)::BIGINT AS inner_outsize FROM r WHERE status <> 'skipped' GROUP BY 1",
        "legacy_final": f"""WITH {RESULTS}, t AS (SELECT source, count(*) AS n, sum(insize)::BIGINT AS insize, sum(outsize)::BIGINT AS outsize, min(path) AS first_path FROM r GROUP BY 1)
  SELECT source, n, insize, outsize, {PCT.format(i="insize", o="outsize")} AS pct, first_path FROM t""",
        "legacy_rows": f"WITH {RESULTS} SELECT source, path, insize, outsize, savings_pct FROM r",
        "bulk_totals_failed": f"""WITH {RESULTS}, w AS (SELECT path, insize, outsize, CASE WHEN doc_id % 19 = 18 THEN 'failed' ELSE status END AS status FROM r),
  e AS (SELECT true AS went_on, * FROM w UNION ALL SELECT false, * FROM w WHERE path <= coalesce((SELECT min(path) FROM w WHERE status = 'failed'), path)),
  t AS (SELECT went_on, count(*) FILTER (WHERE status = 'processed') AS files_processed, count(*) FILTER (WHERE status = 'failed') AS files_failed, count(*) FILTER (WHERE status = 'skipped') AS files_skipped,
  coalesce(sum(insize) FILTER (WHERE status = 'processed'), 0)::BIGINT AS total_original_size, coalesce(sum(outsize) FILTER (WHERE status = 'processed'), 0)::BIGINT AS total_final_size FROM e GROUP BY 1)
  SELECT *, total_original_size - total_final_size AS total_saved, {PCT.format(i="total_original_size", o="total_final_size")} AS percent_saved FROM t""",
        "pdf_plans": f"""WITH {ASKED} SELECT doc_id, CASE WHEN known THEN CASE WHEN down THEN 'gs, qpdf' ELSE 'images, qpdf' END END AS route,
  CASE WHEN known AND down THEN CASE profile WHEN '/Ebook' THEN 'ebook' WHEN 'screen' THEN 'screen' ELSE 'ebook' END END AS profile,
  CASE WHEN known AND down THEN round(0.15::DOUBLE + (100 - quality) * 2.25::DOUBLE / 99.0::DOUBLE, 3) END AS qfactor
  FROM (SELECT *, profile IS DISTINCT FROM 'ultra' AS known, lossy OR profile IS NOT NULL OR quality IS NOT NULL AS down FROM asked)""",
        "image_plans": f"""WITH {ASKED} SELECT doc_id, CASE WHEN lossy OR quality IS NOT NULL THEN 'jpegoptim' ELSE 'jpegtran,jpegoptim' END AS steps,
  CASE WHEN lossy OR quality IS NOT NULL THEN coalesce(quality, 85) END AS quality, CASE WHEN keep THEN 'all' ELSE 'none' END AS metadata,
  CASE WHEN lossy OR png IS NOT NULL THEN 'pngquant' WHEN ultra THEN 'oxipng,zopflipng' ELSE 'oxipng' END AS candidates,
  CASE WHEN lossy OR png IS NOT NULL THEN CASE WHEN png = 'low' THEN 3 ELSE 1 END END AS speed FROM asked""",
        "video_plans": f"""WITH {ASKED}, v AS (SELECT *, CASE WHEN packer IN ('mp4', 'mkv', 'webm', 'mov', 'm4v') OR (packer IN ('3gp', 'ts', 'mts', 'm2ts') AND NOT convert) THEN packer ELSE 'mp4' END AS container,
  packer NOT IN ('mp4', 'mkv', 'webm', 'mov', 'm4v') AND convert AS moved FROM asked WHERE packer IN ('wmv', 'mp4', 'avi', 'asf', 'mkv', 'webm', 'mov', 'm4v', '3gp', 'ts', 'mts', 'm2ts'))
  SELECT doc_id, container, CASE WHEN moved THEN regexp_replace(path, '\\.[^.]*$', '') || '.mp4' ELSE path END AS dest, moved, CASE container WHEN 'webm' THEN 'libvpx-vp9' ELSE 'libx264' END AS codec,
  CASE WHEN NOT ultra THEN 18 WHEN container <> 'webm' THEN 0 END AS crf, CASE WHEN container <> 'webm' THEN CASE WHEN ultra THEN 'veryslow' ELSE 'slow' END END AS preset,
  container IN ('mp4', 'mov', 'm4v') AS faststart, CASE WHEN container IN ('mp4', 'mov', 'm4v', '3gp') THEN 'mp4' WHEN container IN ('ts', 'mts', 'm2ts') THEN 'ts' ELSE container END AS "check" FROM v""",
        "packer_options": f"""WITH {ASKED}, o(n, name, packers) AS (VALUES {", ".join(f"({n}, {text(PACKER_NAME.get(k, k))}, {text(v)})" for n, (k, v) in enumerate(OPTION_OF.items()))})
  SELECT doc_id, packer, coalesce(string_agg(o.name, ',' ORDER BY o.n), '') AS options FROM asked LEFT JOIN o ON list_contains(split(o.packers, ' '), packer) GROUP BY doc_id, packer""",
        "extract_limit_texts": f"""WITH {ASKED}, l AS (SELECT doc_id, size, CASE "limit" WHEN '0' THEN 0 WHEN '1.5KB' THEN 1536 WHEN '10MB' THEN 10485760 END::BIGINT AS bytes, CASE WHEN "limit" = '0' THEN 0.0::DOUBLE END AS ratio FROM asked)
  SELECT doc_id, bytes, ratio, (coalesce(bytes, {R.MAX_EXTRACT_BYTES}) > 0 AND size * 90 > coalesce(bytes, {R.MAX_EXTRACT_BYTES})) AS over FROM l""",
        "archive_writers": f"""WITH {PATHS} SELECT CASE WHEN starts_with(family, 'tar.') THEN 'tar, ' || split_part(family, '.', 2) WHEN family = 'zip' AND list_contains({listed(R.SENSITIVE)}, key) THEN 'zip, bare' ELSE family END AS writer,
  count(*) AS files FROM kinds WHERE family <> 'standalone' GROUP BY 1""",
        "name_gate": f"""WITH {PATHS}, g AS (SELECT size, CASE WHEN list_has_any(split(replace(path, chr(92), '/'), '/')[:-2], {listed(R.EXCLUDED_DIRS)}) THEN 'excluded directory' WHEN ext = 'zip' THEN 'zip skipped'
  WHEN size < 300 THEN 'File size n < min_size 300' WHEN list_contains({listed(["otf", *R.PEEKED])}, ext) THEN '' WHEN family IS NULL THEN 'unsupported'
  WHEN c.v IN ('image', 'audio', 'video') THEN 'media off' WHEN family <> 'standalone' AND NOT list_contains({listed(READABLE)}, family) THEN 'tool missing'
  WHEN family = 'standalone' AND NOT list_contains({listed(list(PACKERS))}, packer) THEN 'tool missing' ELSE '' END AS reason FROM kinds LEFT JOIN {values(R.CATEGORY_OF)} c(k, v) ON c.k = packer)
  SELECT reason, count(*) AS files, sum(size)::BIGINT AS bytes FROM g GROUP BY 1""",
        "nested_members": f"""WITH {PATHS}, m AS (SELECT (doc_id % 3)::INT AS depth, family <> 'standalone' AS is_archive FROM kinds WHERE family IS NOT NULL)
  SELECT depth, is_archive, count(*) FILTER (WHERE NOT is_archive OR depth = 0) AS open, count(*) AS members FROM m GROUP BY 1, 2""",
        "pdf_headers": """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN true WHEN doc_id % 4 = 1 THEN octet_length(encode(text)) <= 1019 OR starts_with(ltrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '%PDF')
  ELSE false END AS is_pdf FROM documents""",
        "sound_codecs": """WITH s AS (SELECT CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'opus' WHEN 2 THEN 'flac' WHEN 3 THEN 'alac' ELSE 'wavpack' END AS codec FROM documents)
  SELECT codec, count(*) AS files, count(*) FILTER (WHERE codec IN ('', 'flac', 'alac')) AS open FROM s GROUP BY 1""",
        "covers": f"""WITH {ASKED} SELECT doc_id, true AS pack_images, keep AS keep_meta, doc_id % 2 = 0 AND lossy AS lossy, ultra, quality AS jpeg_quality, png AS png_quality FROM asked
  WHERE packer IN ('flac', 'm4a', 'wv', 'ape', 'tta', 'oga', 'ogg', 'mp3')""",
        "run_rates": f"""WITH {RESULTS}, t AS (SELECT source, count(*) FILTER (WHERE status <> 'skipped')::DOUBLE AS files, count(*) FILTER (WHERE status = 'skipped') * 0.5::DOUBLE AS seconds FROM r GROUP BY 1)
  SELECT source, seconds / nullif(files, 0) AS seconds_per_file, files / nullif(seconds, 0) AS files_per_second FROM t""",
        "dir_lists": "SELECT doc_id, CASE WHEN source = lang THEN source ELSE source || '|' || lang END AS dirs FROM documents",
        "backup_plan": """WITH p AS (SELECT DISTINCT source, 'f' || (doc_id % 50) AS stem, CASE WHEN doc_id % 2 = 0 THEN '.json' ELSE '' END AS ext FROM documents),
  n AS (SELECT 'd/' || source || '/' || stem || ext AS path, source, stem, ext, row_number() OVER (PARTITION BY stem || ext ORDER BY 'd/' || source || '/' || stem || ext) AS k FROM p)
  SELECT path, 'b/' || CASE WHEN k = 1 THEN stem || ext ELSE source || '_' || stem || ext END AS backup_path FROM n""",
        "report_csv": f"WITH {RESULTS} SELECT path AS file, insize AS original_size, outsize AS final_size, printf('%.2f', savings_pct) AS savings_percent, insize - outsize AS savings_bytes FROM r",
        "size_functions": f"""WITH z AS (SELECT doc_id, source, {list(PARSED.values())}[doc_id % {len(SIZES)} + 1]::BIGINT AS parsed, trunc(n_chars * pow(2.0::DOUBLE, (doc_id % 44)::DOUBLE))::BIGINT AS size, (doc_id % 110)::INT AS q, (doc_id % 12)::INT AS level FROM documents)
  SELECT doc_id, parsed, {SHOW} AS shown, round(0.15::DOUBLE + (100 - least(100, greatest(1, q))) * 2.25::DOUBLE / 99.0::DOUBLE, 3) AS qfactor, CASE WHEN level <= 2 THEN 'm3' WHEN level <= 4 THEN 'm4' ELSE 'm5' END AS rar,
  least(9, greatest(1, level)) AS zip_level, CASE WHEN doc_id % 2 = 0 THEN 'ebook' END AS profile, 'docx|' || lower(source) || '|.x' AS exts FROM z""",
        "parquet_roundtrip": "SELECT * FROM lineitem",
        "orc_roundtrip": "SELECT * FROM orders",
        "zip_walk": ARCHIVES.format(ext="docx"),
        "tar_walk": ARCHIVES.format(ext="tar"),
        "nested_walk": "SELECT source || '-' || (doc_id // 4000) || '.epub' AS path, 'packed' AS status, count(DISTINCT doc_id // 500) AS inner_count, true AS smaller FROM documents GROUP BY source, doc_id // 4000",
        "sqlite_vacuum": "SELECT source, count(*) FILTER (WHERE doc_id % 2 = 0) AS n, coalesce(sum(octet_length(encode(coalesce(text, '')))) FILTER (WHERE doc_id % 2 = 0), 0)::BIGINT AS bytes, true AS no_larger FROM documents GROUP BY 1",
        "psd_rezip": "SELECT doc_id, coalesce(text, '') AS text, true AS no_larger FROM documents",
        "dicom_gate": "SELECT doc_id, doc_id % 3 <> 1 AND doc_id % 4 <> 0 AND doc_id % 5 <> 0 AS packable FROM documents",
    }
    smaller = ", CASE WHEN octet_length(encode(coalesce(text, ''))) >= 1000 THEN true END AS smaller"
    return found | {f"stream_roundtrip_{c}": f"SELECT doc_id, coalesce(text, '') AS text{smaller if c in DOUBLED else ''} FROM documents" for c in ("gz", "xz", "bz2", "lzma", "zst", "br", "lz4")}

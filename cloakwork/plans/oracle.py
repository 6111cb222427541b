"""SQL of the queries for DuckDB, over the same shaped views."""

from __future__ import annotations

from ..rules import (
    BINARY_VRS,
    BLANK_KEYWORDS,
    BLANK_TAGS,
    DISPLAY_KEYWORDS,
    ID_TAGS,
    KEEP_KEYWORDS,
    KEEP_TAGS,
    NAME_TAGS,
    PSEUDO_TAGS,
    SCRUB_VRS,
    TEXT_TAGS,
    TEXT_VRS,
)
from .testbed import LISTING, REPORTS, duck, elements_text


def _in(names: list[str]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _tag(tag: str) -> str:
    return f"(<{tag}\\b[^>]*>)(.*?)(</{tag}>)"


def _set(text: str, tags: list[str], by: str) -> str:
    for tag in tags:
        text = f"regexp_replace({text}, '{_tag(tag)}', '\\1' || {by} || '\\3', 'gis')"
    return text


def _values(tag: str) -> str:
    return f"regexp_extract_all(text, '{_tag(tag)}', 2, 'is')"


def _scrubbed(text: str, by: str) -> str:
    return f"coalesce(list_reduce(list_prepend({text}, tokens), lambda acc, t: replace(acc, t, {by})), {text})"


def _uid(v: str) -> str:
    part = lambda at: f"lpad(CAST(CAST('0x' || substr(sha256({v}), {at}, 15) AS BIGINT) AS VARCHAR), 19, '0')"
    return f"'2.25.1' || {part(1)} || {part(16)}"


def _remap(v: str) -> str:
    return f"({v} <> '' AND {v} <> '1.2.840.10008' AND NOT starts_with({v}, '1.2.840.10008.'))"


def _meets(texts: str, key: str) -> str:
    """Which tokens' last characters a text has somewhere: all tokens that it can contain, without comparing all pairs."""
    parts = f"SELECT DISTINCT k, q, substr(text, i, q) AS tail FROM (SELECT k, text, unnest(generate_series(1, length(text))) AS i FROM (SELECT DISTINCT {key} AS k, text FROM {texts})), (SELECT DISTINCT q FROM token_tails)"
    return f"SELECT DISTINCT k AS {key}, token FROM ({parts}) JOIN token_tails USING (tail, q)"


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_OVER = "(({0}.\"group\" BETWEEN 20480 AND 20735) OR ({0}.\"group\" BETWEEN 24576 AND 24831))"
_BLANK = f"coalesce({{0}}.keyword IN {_in(BLANK_KEYWORDS)}, false)"
#: The same under the registered policy: ProtocolName removed too, AccessionNumber and StationName kept, and in reports StudyDate and PatientBirthday.
_POLICY_BLANK = f"coalesce(({{0}}.keyword IN {_in(BLANK_KEYWORDS)} OR lower({{0}}.keyword) = 'protocolname') AND lower({{0}}.keyword) NOT IN ('accessionnumber', 'stationname'), false)"
_POLICY_TAGS = [t for t in BLANK_TAGS if t != "PatientBirthday"] + ["StudyDate"]
MASK = "CASE WHEN length({0}) <= 2 THEN repeat('•', length({0})) ELSE {0}[1] || repeat('•', CAST(least(length({0}) - 2, 8) AS BIGINT)) || {0}[-1] END"
JOINED = "array_to_string(\"values\", '\\')"
CTX = "substr(text, CAST(greatest(1, {at} - 20) AS BIGINT), CAST({at} + {n} + 20 - greatest(1, {at} - 20) AS BIGINT))"
PHONE, IDCARD = "(^|[^0-9A-Za-z])(1[3-9]\\d{9})([^0-9A-Za-z]|$)", "(^|[^0-9A-Za-z])(\\d{17}[\\dXx])([^0-9A-Za-z]|$)"


def _action(dates: str = "true", blank: str = _BLANK) -> str:
    goes = f"({_OVER.format('a')} OR a.\"group\" % 2 = 1 OR (a.vr = 'SQ' AND {blank.format('a')}))"
    uids = f"(vr = 'UI' AND len(list_filter(\"values\", lambda v: {_remap('v')})) > 0)"
    return f"""CASE WHEN scope = 'meta' THEN CASE WHEN {uids} THEN 'remap' ELSE 'keep' END
      WHEN len(list_filter(ancestors, lambda a: {goes})) > 0 THEN 'drop_nested'
      WHEN {_OVER.format("e")} THEN 'drop_overlay' WHEN "group" % 2 = 1 THEN 'drop_private'
      WHEN "group" = 16 AND element IN (16, 32) THEN 'pseudonymise'
      WHEN {blank.format("e")} THEN CASE WHEN vr = 'SQ' THEN 'drop_sequence' ELSE 'blank' END
      WHEN vr = 'PN' THEN 'blank_person'
      WHEN vr IN ('DA', 'DT') AND {JOINED} <> '' AND NOT {dates} THEN 'blank_date'
      WHEN {uids} THEN 'remap' WHEN vr IN {_in(SCRUB_VRS)} AND len("values") = 1 THEN 'scrub' ELSE 'keep' END"""


def _harvest_tags(tags: list[str], kind: str) -> str:
    return " UNION ALL ".join(f"SELECT patient_key, unnest({_values(t)}) AS token, '{kind}' AS token_kind FROM reports" for t in tags)


_AFTER = f"""CASE WHEN action = 'pseudonymise' THEN [pseudo_id] WHEN starts_with(action, 'blank') THEN ['']
  WHEN action = 'remap' THEN list_transform("values", lambda v: CASE WHEN {_remap("v")} THEN {_uid("v")} ELSE v END)
  WHEN action = 'scrub' THEN [{_scrubbed('"values"[1]', "pseudo_id")}] ELSE "values" END"""

VIEWS = {
    "listing": duck(LISTING),
    "inventory": r"""SELECT *, CASE WHEN contains(rel_path, '/') THEN split_part(rel_path, '/', 1) END AS patient_key,
      regexp_replace(rel_path, '/?[^/]*$', '') AS parent, regexp_extract(rel_path, '[^/]*$') AS name,
      lower(regexp_extract(regexp_extract(rel_path, '[^/]*$'), '[^.](\.[^.]+)$', 1)) AS ext FROM listing""",
    "files": """SELECT *, left(name, CAST(length(name) - length(ext) AS BIGINT)) AS stem, CASE WHEN ext IN ('.dcm', '.ima') OR (ext = '' AND magic) THEN 'dicom' WHEN ext = '.xml' THEN 'xml'
      WHEN ext = '.pdf' THEN 'pdf' WHEN ext IN ('.jpg', '.jpeg', '.png', '.bmp', '.tif', '.tiff') THEN 'image' ELSE 'other' END AS kind FROM inventory""",
    "assigned": "SELECT patient_key, row_number() OVER (ORDER BY patient_key) AS patient_no, printf('Patient_%04d', row_number() OVER (ORDER BY patient_key)) AS pseudo_id FROM (SELECT DISTINCT patient_key FROM files WHERE patient_key IS NOT NULL)",
    "elements": duck(elements_text(True)),
    "reports": duck(REPORTS),
    "first_headers": "SELECT patient_key, parent, min(rel_path) AS rel_path, arg_min(file_id, rel_path) AS file_id FROM files WHERE kind = 'dicom' GROUP BY ALL",
    "pieces": """SELECT patient_key, token, CASE WHEN regexp_full_match(token, '[0-9]+') THEN CASE WHEN length(token) >= 4 THEN 'id' END WHEN length(token) >= 2 THEN 'name' END AS token_kind
      FROM (SELECT patient_key, unnest(string_split(stem, '_')) AS token FROM files WHERE kind = 'xml')""",
    "harvest": f"""SELECT DISTINCT patient_key, {_STRIP.format("token")} AS token, token_kind FROM (
      SELECT patient_key, patient_key AS token, 'name' AS token_kind FROM files WHERE patient_key IS NOT NULL UNION ALL SELECT * FROM pieces WHERE token_kind IS NOT NULL
      UNION ALL {_harvest_tags([*NAME_TAGS, *TEXT_TAGS], "name")} UNION ALL {_harvest_tags(ID_TAGS, "id")}
      UNION ALL SELECT h.patient_key, {JOINED}, CASE keyword WHEN 'PatientName' THEN 'name' ELSE 'id' END FROM first_headers h JOIN elements e USING (file_id)
        WHERE scope = 'dataset' AND len(ancestors) = 0 AND keyword IN ('PatientName', 'PatientID', 'AccessionNumber')) WHERE {_STRIP.format("token")} <> ''""",
    "crosswalk": "SELECT pseudo_id, patient_key, coalesce(list_sort(list(token) FILTER (token_kind = 'name')), []) AS real_names, coalesce(list_sort(list(token) FILTER (token_kind = 'id')), []) AS real_ids FROM assigned LEFT JOIN harvest USING (patient_key) GROUP BY ALL",
    "own_list": "SELECT DISTINCT patient_key, token FROM harvest WHERE length(token) >= 2",
    "own": "SELECT patient_key, pseudo_id, tokens FROM assigned LEFT JOIN (SELECT patient_key, list(token ORDER BY length(token) DESC, token) AS tokens FROM own_list GROUP BY 1) USING (patient_key)",
    "all_tokens": "SELECT token, arg_max(pseudo_id, patient_no) AS pseudo_id FROM own_list JOIN assigned USING (patient_key) GROUP BY 1",
    "token_tails": "SELECT token, right(token, 6) AS tail, length(right(token, 6)) AS q FROM all_tokens",
    "acted": f"SELECT e.*, {_action()} AS action FROM elements e",
    "acted_undated": f"SELECT e.*, {_action('false')} AS action FROM elements e",
    "deid": f"SELECT a.* EXCLUDE (patient_key), a.patient_key, pseudo_id, {_AFTER} AS values_after FROM acted a LEFT JOIN own USING (patient_key) WHERE NOT starts_with(action, 'drop')",
    "acted_policy": f"SELECT e.*, {_action(blank=_POLICY_BLANK)} AS action FROM elements e",
    "deid_policy": f"SELECT a.* EXCLUDE (patient_key), a.patient_key, pseudo_id, {_AFTER} AS values_after FROM acted_policy a LEFT JOIN own USING (patient_key) WHERE NOT starts_with(action, 'drop')",
    "clean_reports": f"SELECT file_id, patient_key, pseudo_id, {_scrubbed('t', 'pseudo_id')} AS text FROM (SELECT *, {_set(_set('text', PSEUDO_TAGS, 'pseudo_id'), BLANK_TAGS, chr(39) * 2)} AS t FROM reports LEFT JOIN own USING (patient_key))",
    "clean_reports_policy": f"SELECT file_id, patient_key, pseudo_id, {_scrubbed('t', 'pseudo_id')} AS text FROM (SELECT *, {_set(_set('text', PSEUDO_TAGS, 'pseudo_id'), _POLICY_TAGS, chr(39) * 2)} AS t FROM reports LEFT JOIN own USING (patient_key))",
    "leaf_hits": r"""SELECT rel_path, unnest(regexp_extract_all(text, '<[A-Za-z_][\w.\-]*>[^<]*</[A-Za-z_][\w.\-]*>', 0)) AS hit, generate_subscripts(regexp_extract_all(text, '<[A-Za-z_][\w.\-]*>[^<]*</[A-Za-z_][\w.\-]*>', 0), 1) AS pos FROM reports""",
    "leaves": r"""SELECT rel_path, pos, regexp_extract(hit, '^<([^>]*)>', 1) AS tag, regexp_replace(regexp_extract(hit, '>([^<]*)<', 1), '^\s+|\s+$', '', 'g') AS value FROM leaf_hits
      WHERE regexp_extract(hit, '^<([^>]*)>', 1) = regexp_extract(hit, '</([^>]*)>$', 1)""",
    "dicom_fields": f"""SELECT 'DICOM' AS source, name, arg_min(vr, seq) AS kind, coalesce(arg_min({MASK.format("v")}, seq) FILTER ({_STRIP.format("v")} <> ''), '') AS sample, count(*) AS "count" FROM
      (SELECT coalesce(keyword, printf('(%04X,%04X)', "group", element)) AS name, vr, {JOINED} AS v, h.rel_path || printf('%08d', "group" * 65536 + element) AS seq FROM first_headers h JOIN elements e USING (file_id)
       WHERE scope = 'dataset' AND len(ancestors) = 0 AND vr NOT IN {_in(BINARY_VRS)}) GROUP BY name""",
    "xml_fields": f"""SELECT 'XML' AS source, tag AS name, 'text' AS kind, coalesce(arg_min({MASK.format("value")}, rel_path || printf('%08d', pos)) FILTER (value <> ''), '') AS sample, count(*) AS "count" FROM leaves WHERE tag NOT LIKE 'xs%' GROUP BY tag""",
    "fields": f"""SELECT *, CASE WHEN name IN ('PatientName', 'PatientID') THEN '假名' WHEN name IN {_in(BLANK_KEYWORDS)} OR kind = 'PN' THEN '去除' WHEN kind = 'UI' THEN '重映射'
        WHEN name IN {_in(KEEP_KEYWORDS)} THEN '保留' WHEN kind IN {_in(TEXT_VRS)} THEN '未知' ELSE '保留' END AS action FROM dicom_fields
      UNION ALL SELECT *, CASE WHEN name IN {_in(PSEUDO_TAGS)} THEN '假名' WHEN name IN {_in(BLANK_TAGS)} THEN '去除' WHEN name IN {_in(KEEP_TAGS)} THEN '保留' ELSE '未知' END FROM xml_fields""",
    "flags": """SELECT file_id, CASE WHEN upper(b) = 'YES' THEN 'BurnedInAnnotation=YES' WHEN upper(m) IN ('SC', 'OT') THEN 'Modality=' || upper(m) WHEN starts_with(s, '1.2.840.10008.5.1.4.1.1.7') THEN 'Secondary Capture'
        WHEN starts_with(s, '1.2.840.10008.5.1.4.1.1.104') THEN 'EncapsulatedDocument' END AS reason FROM (SELECT file_id, max("values"[1]) FILTER (keyword = 'BurnedInAnnotation') AS b, max("values"[1]) FILTER (keyword = 'Modality') AS m,
        max("values"[1]) FILTER (keyword = 'SOPClassUID') AS s FROM elements WHERE scope = 'dataset' AND len(ancestors) = 0 GROUP BY 1) WHERE reason IS NOT NULL""",
    "report_meets": _meets("clean_reports", "file_id"),
    "token_leaks": f"""SELECT file_id, 'token' AS kind, token, {CTX.format(at="place", n="length(token)")} AS detail FROM (SELECT file_id, text, token, CASE WHEN regexp_full_match(token, '[0-9]+') THEN
        CASE WHEN regexp_matches(text, '(^|[^0-9])' || token || '([^0-9]|$)') THEN length(regexp_extract(text, '^(.*?)(^|[^0-9])' || token || '([^0-9]|$)', 1, 's')) + length(regexp_extract(text, '^(.*?)(^|[^0-9])' || token || '([^0-9]|$)', 2, 's')) + 1 ELSE 0 END
        ELSE strpos(text, token) END AS place FROM clean_reports JOIN report_meets USING (file_id) WHERE contains(text, token)) WHERE place > 0""",
    "pattern_leaks": " UNION ALL ".join(
        f"""SELECT file_id, 'pattern' AS kind, '{label}' AS token, {CTX.format(at="place", n="length(hit)")} AS detail FROM (SELECT file_id, text, regexp_extract(text, '{p}', 2) AS hit,
        length(regexp_extract(text, '^(.*?){p}', 1, 's')) + length(regexp_extract(text, '^(.*?){p}', 2, 's')) + 1 AS place FROM clean_reports WHERE regexp_matches(text, '{p}'))"""
        for label, p in (("身份证号", IDCARD), ("手机号", PHONE))
    ),
    "element_texts": f"""SELECT file_id, printf('(%04x,%04x)', "group", element) AS detail, array_to_string(values_after, '\\') AS text FROM deid WHERE scope = 'dataset' AND vr NOT IN {_in(BINARY_VRS)}""",
    "element_meets": f"SELECT text, token FROM ({_meets('element_texts', 'text')}) WHERE contains(text, token)",
    "element_leaks": f"""SELECT file_id, 'token' AS kind, token, detail FROM element_texts JOIN (SELECT text, token FROM element_meets
        WHERE NOT regexp_full_match(token, '[0-9]+') OR regexp_matches(text, '(^|[^0-9])' || token || '([^0-9]|$)')) USING (text)
      UNION ALL SELECT file_id, 'pattern', '身份证号', detail FROM element_texts WHERE regexp_matches(text, '{IDCARD}') UNION ALL SELECT file_id, 'pattern', '手机号', detail FROM element_texts WHERE regexp_matches(text, '{PHONE}')""",
    "leaks": "SELECT * FROM token_leaks UNION ALL SELECT * FROM pattern_leaks UNION ALL SELECT file_id, kind, token, detail FROM element_leaks",
    "displayed": f"SELECT * FROM elements WHERE scope = 'dataset' AND len(ancestors) = 0 AND keyword IN {_in(DISPLAY_KEYWORDS)}",
}


def with_views(body: str) -> str:
    """The body after the views that it needs, in order."""
    import re

    needed, queue = set(), [body]
    while queue:
        text = queue.pop()
        for name, view in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                queue.append(view)
    heads = [f"{name} AS MATERIALIZED ({view})" for name, view in VIEWS.items() if name in needed]
    return ("WITH " + ",\n".join(heads) + "\n" if heads else "") + body

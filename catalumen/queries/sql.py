"""SQL fragments that several queries share."""

from __future__ import annotations

from catalumen.functions.constants import EXTENSIONS


def name(path: str) -> str:
    return f"regexp_extract({path}, '[^/]*$', 0)"


def parent(path: str) -> str:
    return f"CASE WHEN contains({path}, '/') THEN regexp_replace({path}, '/[^/]*$', '') WHEN {path} IS NOT NULL THEN '' END"


def suffix(n: str) -> str:
    return f"regexp_extract({n}, '(?s)^.+(\\.[^.]+)$', 1)"


def stem(n: str) -> str:
    return f"left({n}, length({n}) - length({suffix(n)}))"


def kind(n: str, forks: bool) -> str:
    cases = "".join(f" WHEN lower({suffix(n)}) IN ({', '.join(repr(e) for e in x)}) THEN '{k}'" for k, x in EXTENSIONS.items())
    return f"CASE{f' WHEN starts_with({n}, chr(46) || chr(95)) THEN {chr(39)}other{chr(39)}' if forks else ''}{cases} WHEN {n} IS NOT NULL THEN 'other' END"


def normal_stem(s: str, dialect: str = "v2") -> str:
    out = f"regexp_replace(lower({s}), '^\\s+|\\s+$', '', 'g')"
    for e in [r"\(copy\)$", "_copy$", *(["_edit$", "-edit$"] if dialect == "v1" else []), r"\(\d+\)$"]:
        out = f"regexp_replace({out}, '{e}', '')"
    return f"trim({out}, '_- ')"


def psd_stem(s: str, dialect: str = "v2") -> str:
    words = r"edit|final|v\d+|copy|retouched" + ("|variant|working" if dialect == "v1" else "")
    out = f"regexp_replace({normal_stem(s, dialect)}, '[-_]({words})$', '')"
    return f"regexp_replace({out}, '\\s*\\(\\d+\\)$', '')" if dialect == "v1" else out


def full_hash(c: str) -> str:
    x = f"lower(trim({c}, E' \\t\\r\\n'))"
    return f"CASE WHEN regexp_full_match({x}, '[0-9a-f]{{64}}') THEN {x} END"


def sparse_hash(c: str) -> str:
    x = f"lower(trim({c}, E' \\t\\r\\n'))"
    return f"CASE WHEN regexp_full_match({x}, 's-[0-9a-f]{{64}}') THEN {x} END"


def phash(c: str) -> str:
    x = f"regexp_replace(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '^0x', '')"
    return f"CASE WHEN regexp_full_match({x}, '[0-9a-f]{{16}}') THEN {x} END"


def flexible_time(c: str) -> str:
    t = f"trim(replace({c}, 'UTC', ''))"
    tail = r"(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?$"
    return (
        f"CASE WHEN regexp_matches({t}, '^(\\d{{4}}-\\d{{2}}-\\d{{2}}|\\d{{4}}:\\d{{2}}:\\d{{2}})[T ]\\d{{2}}:\\d{{2}}:\\d{{2}}{tail}') "
        f"THEN try_cast(regexp_replace({t}, '^(\\d{{4}})[-:](\\d{{2}})[-:](\\d{{2}})[T ](\\d{{2}}:\\d{{2}}:\\d{{2}})(?s:.*)$', '\\1-\\2-\\3 \\4') AS TIMESTAMP) "
        f"WHEN regexp_matches({t}, '^\\d{{8}}T\\d{{6}}{tail}') "
        f"THEN try_cast(regexp_replace({t}, '^(\\d{{4}})(\\d{{2}})(\\d{{2}})T(\\d{{2}})(\\d{{2}})(\\d{{2}})(?s:.*)$', '\\1-\\2-\\3 \\4:\\5:\\6') AS TIMESTAMP) END"
    )


#: One metadata row per file.
META = """meta AS (
  SELECT file_id, capture_datetime, camera_model, lens_model, width, height, phash FROM media_metadata WHERE file_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY concat_ws('|', coalesce(capture_datetime, ''), coalesce(camera_model, ''),
    coalesce(lens_model, ''), coalesce(width::VARCHAR, ''), coalesce(height::VARCHAR, ''), coalesce(phash, '')) DESC) = 1)"""
#: Files with metadata and the capture time as the catalogue keeps it, without zone.
CAPTURES = META + f""",
captures AS (SELECT f.id, f.type, f.orig_name, m.capture_datetime, m.camera_model, m.phash, m.width, m.height, {flexible_time('m.capture_datetime')} AS taken_at
  FROM files f LEFT JOIN meta m ON f.id = m.file_id)"""
#: The same with the time of the file where there is no other.
PLANNED = CAPTURES + """,
clock AS (SELECT file_id AS id, min(mtime) AS mtime FROM file_occurrences WHERE mtime > 0 AND mtime < 4102444800 GROUP BY file_id),
dated AS (SELECT c.* EXCLUDE (taken_at), coalesce(c.taken_at, make_timestamp((floor(k.mtime) * 1000000)::BIGINT)) AS taken_at FROM captures c LEFT JOIN clock k USING (id))"""


def numbered(style: str = "_{}") -> str:
    """CTEs after wants (id, folder, want, pass, kind, first_id) and taken (folder, name): named (id, folder, name), each folder
    gone through row by row in order, the first free number for a name that is there."""
    before, after = (f"'{x}'" for x in style.split("{}"))
    with_number = f"st || {before} || k || {after} || ext"
    return f"""w AS (SELECT id, folder, want, {stem('want')} AS st, {suffix('want')} AS ext, row_number() OVER (PARTITION BY folder ORDER BY pass, kind, first_id, id) AS n FROM wants),
u AS (SELECT folder, list(DISTINCT name) AS names FROM taken GROUP BY folder),
steps(folder, n, id, name, names) AS (
  SELECT folder, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, coalesce(u.names, []::VARCHAR[]) FROM (SELECT DISTINCT folder FROM w) LEFT JOIN u USING (folder)
  UNION ALL
  SELECT folder, n, id, name, list_append(names, name) FROM (SELECT s.folder, w.n, w.id, s.names, CASE WHEN NOT list_contains(s.names, w.want) THEN w.want
      ELSE list_filter(list_transform(range(1, len(s.names) + 2), lambda k: {with_number}), lambda x: NOT list_contains(s.names, x))[1] END AS name
    FROM steps s JOIN w ON w.folder = s.folder AND w.n = s.n + 1)),
named AS (SELECT id, folder, name FROM steps WHERE id IS NOT NULL)"""

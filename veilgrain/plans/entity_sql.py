"""SQL twins of the text scans, used only to check results."""

from __future__ import annotations

from veilgrain import constants as K

PATTERNS = {
    "EMAIL": K.EMAIL_PATTERN,
    "PHONE": K.PHONE_PATTERN,
    "CREDIT_CARD": K.CARD_PATTERN,
    "GOVT_ID": K.PASSPORT_PATTERN,
    "NAME": K.LABELLED_NAME_PATTERN,
    "PASSWORD": K.SECRET_PATTERN,
}
KNOWN = r"(?i)\b(" + "|".join(K.KNOWN_NAMES) + r")\b"
ORDER = ("EMAIL", "PHONE", "CREDIT_CARD", "GOVT_ID", "NAME", "PASSWORD")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def masked(kind: str, raw: str = "raw_value") -> str:
    if kind == "EMAIL":
        return f"substr({raw}, 1, 1) || '***@***.com'"
    if kind == "PHONE":
        return f"'{K.BULLETS8}' || right({raw}, 4)"
    if kind == "CREDIT_CARD":
        return f"'{K.CARD_MASK}' || right(regexp_replace({raw}, '[^0-9]', '', 'g'), 4)"
    if kind == "NAME":
        return f"substr({raw}, 1, 1) || '*** ' || substr(split_part({raw}, ' ', 2), 1, 1) || '***'"
    return f"'{K.BULLETS8}'"


def hits(kind: str, table: str, key: str, pattern: str, where: str = "true") -> str:
    """``src_id, i, raw_value, pos`` of one pattern."""
    p = quoted(pattern)
    name_shift = ""
    raw = "h[i]"
    if kind == "NAME":
        raw = "n[i]"
        name_shift = " + length(h[i]) - length(n[i])"
    return f"""SELECT src_id, i, {raw} AS raw_value,
        CAST(coalesce(list_sum(list_transform(g[1:i], lambda s: length(s))), 0)
          + coalesce(list_sum(list_transform(h[1:i-1], lambda s: length(s))), 0){name_shift} AS INTEGER) AS pos
      FROM (SELECT src_id, h, g, n, unnest(range(1, len(h) + 1)) AS i FROM (
        SELECT {key} AS src_id, regexp_extract_all(text, {p}) AS h, regexp_extract_all(text, {p}, {1 if kind == 'NAME' else 0}) AS n,
          string_split_regex(text, {p}) AS g FROM {table} WHERE {where}))"""


def kind_sql(kind: str, table: str, key: str) -> str:
    conf, sens, nec, treat = K.TEXT_ENTITY_SPECS[kind]
    body = hits(kind, table, key, PATTERNS[kind])
    if kind == "NAME":
        lacks = f"len(regexp_extract_all(text, {quoted(K.LABELLED_NAME_PATTERN)})) = 0"
        body += " UNION ALL " + hits("NAME", table, key, KNOWN, lacks)
    keep = ""
    if kind == "CREDIT_CARD":
        keep = "WHERE length(regexp_replace(raw_value, '[^0-9]', '', 'g')) BETWEEN 13 AND 19"
    return f"""SELECT src_id, {ORDER.index(kind)} AS kind_ord, i, '{kind}' AS kind, pos, raw_value, {masked(kind)} AS masked,
        {conf} :: DOUBLE AS confidence, '{sens}' AS sensitivity, '{nec}' AS necessity, '{treat}' AS treatment
      FROM ({body}) {keep}"""


def entities_sql(table: str, key: str, kinds=ORDER) -> str:
    union = " UNION ALL ".join(kind_sql(k, table, key) for k in kinds)
    return f"""SELECT src_id, CAST(row_number() OVER (PARTITION BY src_id ORDER BY kind_ord, i) - 1 AS INTEGER) AS entity_ord,
        kind, pos, raw_value, masked, confidence, sensitivity, necessity, treatment, 'REGEX' AS source FROM ({union})"""


def region_sql(table: str, keys: str, text: str = "text") -> str:
    """First match per kind, as ``keys, entity_ord, kind, ...``."""
    q = {k: quoted(p) for k, p in PATTERNS.items()}
    skip = " OR ".join(f"contains({text}, '{m}')" for m in K.REGION_SKIP_MARKS)
    firsts = f"""SELECT {keys}, {text} AS region_text,
        nullif(regexp_extract({text}, {q['EMAIL']}), '') AS m0,
        nullif(regexp_extract({text}, {q['CREDIT_CARD']}), '') AS m1,
        nullif(regexp_extract({text}, {q['GOVT_ID']}), '') AS m2,
        nullif(regexp_extract({text}, {q['PHONE']}), '') AS m3,
        coalesce(nullif(regexp_extract({text}, {q['NAME']}, 1), ''), nullif(regexp_extract({text}, {quoted(KNOWN)}, 1), '')) AS m4,
        nullif(regexp_extract({text}, {q['PASSWORD']}), '') AS m5 FROM {table} WHERE NOT ({skip})"""
    arms = []
    for i, kind in enumerate(("EMAIL", "CREDIT_CARD", "GOVT_ID", "PHONE", "NAME", "PASSWORD")):
        cond = f"m{i} IS NOT NULL"
        if kind == "CREDIT_CARD":
            cond += " AND length(regexp_replace(m1, '[^0-9]', '', 'g')) BETWEEN 13 AND 19"
        if kind == "PHONE":
            cond += " AND m1 IS NULL"
        _, sens, nec, treat = K.TEXT_ENTITY_SPECS[kind]
        arms.append(
            f"""SELECT {keys}, {i} AS k, '{kind}' AS kind, CAST(instr(region_text, m{i}) - 1 AS INTEGER) AS pos, m{i} AS raw_value,
            {masked(kind, f'm{i}')} AS masked, {K.REGION_CONFIDENCE[kind]} :: DOUBLE AS confidence, '{sens}' AS sensitivity,
            '{nec}' AS necessity, '{treat}' AS treatment FROM firsts WHERE {cond}"""
        )
    union = " UNION ALL ".join(arms)
    return f"""SELECT {keys}, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY k) - 1 AS INTEGER) AS entity_ord, kind, pos,
        raw_value, masked, confidence, sensitivity, necessity, treatment, true AS visual_only
      FROM (WITH firsts AS ({firsts}) {union})"""

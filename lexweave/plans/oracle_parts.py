"""Pieces of SQL that several oracles share, made from the same lexicons as the Spark expressions."""

from __future__ import annotations

from ..functions import rules as R

SPACE = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_of(c: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {quoted(t)})" for t in terms) + ")"


def first_of(c: str, rules: list, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(c, t)} THEN '{v}'" for v, t in rules) + f" ELSE '{default}' END"


def facts_sql(rows: str) -> str:
    """SELECT of all columns of ``rows`` (which has txt) with the fact columns, arrays as lists."""
    media = [f"CASE WHEN {any_of('t', terms)} THEN '{v}' END" for v, terms in R.MEDIUM]
    media.append("CASE WHEN regexp_matches(t, '(^|[^트크])롤($|[^러케모링])') THEN 'game_chat' END")
    rank = {v: i for i, (v, _) in enumerate(R.MEDIUM)}
    del rank
    return f"""
    SELECT *, list_filter([
        CASE WHEN NOT medium IN ('unknown', 'direct_delivery') THEN '통신매체' END, CASE WHEN reached = 'yes' THEN '도달' END, CASE WHEN sexual THEN '성적표현' END,
        CASE WHEN context = 'conflict' THEN '분노' END, CASE WHEN medium = 'sns_mention' OR recipient = 'mention' THEN '멘션' END,
        CASE WHEN repetition = 'once' THEN '단발성' END, CASE WHEN repetition = 'repeated' THEN '반복성' END], lambda x: x IS NOT NULL) AS tags
    FROM (
      SELECT *, CASE WHEN {any_of('t', R.MENTION)} THEN 'mention' WHEN medium = 'bank_transfer' THEN 'bank_account' WHEN {any_of('t', R.PUBLIC)} THEN 'public_post'
          WHEN medium IN ('kakao', 'game_chat', 'sns_mention', 'digital_message') THEN 'direct_account' ELSE 'unknown' END AS recipient,
        {first_of('t', R.REACHED, 'unknown')} AS reached, {first_of('t', R.RELATIONSHIP, 'unknown')} AS relationship, {first_of('t', R.CONTEXT, 'unknown')} AS context,
        {first_of('t', R.REPETITION, 'unknown')} AS repetition, CASE WHEN image THEN 'image' ELSE 'text' END AS form,
        CASE WHEN image THEN 'sexual_image' WHEN sexual AND insult THEN 'insult_with_sexual_terms' WHEN sexual THEN 'sexual_text' ELSE 'other' END AS expression
      FROM (
        SELECT *, coalesce(media[1], 'unknown') AS medium, {any_of('t', R.SEXUAL + R.SLURS)} AS sexual, {any_of('t', R.INSULT)} AS insult, {any_of('t', R.IMAGE)} AS image
        FROM (
          SELECT *, list_filter(raw, lambda x, i: x IS NOT NULL AND list_position(raw, x) = i) AS media
          FROM (SELECT *, [{', '.join(media)}] AS raw FROM (SELECT *, lower(coalesce(txt, '')) AS t FROM ({rows}))))))"""


def compare_sql(query: dict[str, str]) -> tuple[str, str]:
    """Fact score and issue score of a row with the fact columns against fixed query facts (plain names to values)."""
    cols = {"medium": "medium", "messageForm": "form", "recipientIdentification": "recipient", "reachedRecipient": "reached", "relationship": "relationship", "context": "context", "expressionType": "expression", "repetition": "repetition"}
    known = [(f, c) for f, c in cols.items() if query[f] not in ("unknown", "other")]
    n = " + ".join(f"({c} NOT IN ('unknown', 'other'))::INT" for _, c in known)
    m = " + ".join(f"({c} = '{query[f]}')::INT" for f, c in known)
    form = "messageForm" in dict(known)
    score = f"CASE WHEN ({n}) = 0 {'OR (' + n + ') = 1' if form else ''} THEN 0 ELSE floor(({m}) * 100.0::DOUBLE / ({n}) + 0.5) END::BIGINT"
    tags = "[" + ", ".join(quoted(t) for t in query["issueTags"]) + "]"
    issue = f"CASE WHEN len(list_distinct(list_concat(tags, {tags}))) = 0 THEN 0 ELSE floor(len(list_intersect(tags, {tags})) * 100.0::DOUBLE / len(list_distinct(list_concat(tags, {tags}))) + 0.5) END::BIGINT"
    return score, issue


def focus_sql(name: str) -> str:
    n = f"regexp_replace(coalesce({name}, ''), '{SPACE}+', '', 'g')"
    target = f"contains({n}, '{R.TARGET}')"
    return f"CASE WHEN {target} AND {any_of(n, R.PERIPHERAL)} THEN 'peripheral' WHEN {target} AND {any_of(n, ['·', '(병합)', ','])} THEN 'mixed' ELSE 'focused' END"


def penalty_sql(focus: str) -> str:
    return f"CASE {focus} WHEN 'peripheral' THEN 30 WHEN 'mixed' THEN 15 ELSE 0 END"


def paragraphs_sql(c: str) -> str:
    """The list of paragraphs of a text."""
    x = f"coalesce({c}, '')"
    for p, to in [(r"(?i)<br\s*/?>", "\n"), (r"(?i)</(?:p|div|li|h[1-6])>", "\n"), ("<[^>]+>", " "), ("(?i)&nbsp;|&#160;", " "), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&amp;", "&")]:
        x = f"regexp_replace({x}, {quoted(p)}, {'chr(10)' if to == chr(10) else quoted(to)}, 'g')"
    return f"list_filter(list_transform(string_split_regex({x}, '\\n+'), lambda p: trim(regexp_replace(p, '{SPACE}+', ' ', 'g'))), lambda p: p <> '')"

"""Rule-based tags: lexicons as data, compiled to Column expressions.

The order of the rules of a field is its precedence. A rule holds if any of its terms occurs in the text or its
pattern matches.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import half_up, nfkc, squeeze, without_space

VERSION = "rule-v2"
SCALARS = ["medium", "messageForm", "recipientIdentification", "reachedRecipient", "relationship", "context", "expressionType", "repetition"]
DEFAULTS = {f: {"messageForm": "text", "expressionType": "other"}.get(f, "unknown") for f in SCALARS}

# --- Fixed values: the lexicons ----------------------------------------------------------------------------------

MEDIUM = [
    ("bank_transfer", ["송금", "계좌", "이체", "1원"]),
    ("kakao", ["카카오", "카톡", "오픈채팅"]),
    ("sns_mention", ["트위터", "sns", "멘션", "인스타", "페이스북", "dm", "디엠", "틱톡", "트윗"]),
    ("game_chat", ["게임", "채팅창", "겜", "귓속말", "인게임", "리그오브레전드", "리그 오브", "배틀그라운드", "배그", "오버워치", "옵치", "메이플", "발로란트", "로스트아크", "서든어택"]),
    ("direct_delivery", ["편지", "출입문", "문에 끼워"]),
    ("digital_message", ["문자", "메시지", "메세지", "메신저"]),
]
MEDIUM_PATTERN = ("game_chat", r"(?<![트크])롤(?!러|케|모|링)")
SEXUAL = ["성적", "음란", "야한", "나체", "성기", "성관계", "통매음", "겜매음"]
SLURS = [
    "패드립", "니애미", "니애비", "애미", "니미", "느금마", "느개비", "ㅇ미", "보지", "자지", "좆", "꼬추", "씹새", "씹년", "씹할", "젖가슴", "젖탱", "따먹", "강간", "성폭행", "자위", "야동",
    "걸레년", "걸레같", "창녀", "섹스", "섹시", "야설", "음담패설", "변태", "몸캠", "딸딸이",
]
INSULT = ["욕설", "비하", "조롱", "모욕", "패드립"]
IMAGE = ["사진", "이미지", "영상", "동영상", "나체"]
RELATIONSHIP = [
    ("partner_or_ex", ["연인", "남자친구", "여자친구", "전남친", "전여친"]),
    ("game_user", ["게임", "같은 팀"]),
    ("neighbor", ["이웃", "옆집"]),
    ("acquaintance", ["동업", "지인", "친구", "아는 사람"]),
    ("online_user", ["온라인", "트위터", "sns", "인스타"]),
    ("stranger", ["모르는", "처음 만난", "일면식"]),
]
CONTEXT = [
    ("conflict", ["다툼", "말다툼", "싸움", "화가", "분노", "욕설", "비하", "조롱"]),
    ("sexual_conversation", ["성관계", "성적인 대화", "연인"]),
    ("one_sided", ["일방적", "갑자기", "원치 않"]),
]
REPETITION = [
    ("repeated", ["반복", "여러 번", "여러번", "여러 차례", "여러차례", "계속", "수차례"]),
    ("once", ["한 번", "한번", "1회", "한 차례", "한차례"]),
]
REACHED = [
    ("no", ["도달하지", "전송하지", "보내지 않", "전달되지 않"]),
    ("yes", ["받았", "받은", "보냈", "전송", "전달", "도달", "메시지", "멘션", "송금", "게시"]),
]
MENTION = ["멘션", "태그", "@"]
PUBLIC = ["게시글", "댓글", "공개 글", "게시판"]
ACCOUNT_MEDIA = ["kakao", "game_chat", "sns_mention", "digital_message"]
TARGET = "통신매체이용음란"
PERIPHERAL = ["13세미만미성년자강간", "강간", "미성년자의제간음", "간음유인", "부착명령"]
RELEVANCE = [TARGET, "성폭력처벌법제13조", "통신매체", "성적욕망", "성적수치심", "성적혐오감"]
LISTED_FORMS = ["말", "음향", "글", "그림", "영상", "물건"]
STATUTE_CONTEXT = ["제13조", "여기서통신매체", "처벌하고있다"]
ORDER_PATTERNS = {
    "civil": "원고",
    "remand": "(환송|이송)한다",
    "reversed": "파기",
    "final_appeal": r"상고를?\s*(모두\s*)?기각",
    "appeal": r"항소를?\s*(모두\s*)?기각",
    "prosecution": r"공소를?\s*(모두\s*)?기각",
    "acquitted": "무죄",
    "sentenced": "(징역|금고|벌금|구류|과료|몰수|추징)",
}
PENALTY = {"peripheral": 30, "mixed": 15, "focused": 0}

# --- The compiler -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class RuleSet:
    """A version and the ordered rules of its fields; any lexicon of the same shape can take the place of KOREAN."""

    version: str
    medium: list
    medium_pattern: tuple[str, str] | None
    relationship: list
    context: list
    repetition: list
    reached: list
    sexual: list
    insult: list
    image: list
    mention: list
    public: list


KOREAN = RuleSet(VERSION, MEDIUM, MEDIUM_PATTERN, RELATIONSHIP, CONTEXT, REPETITION, REACHED, SEXUAL + SLURS, INSULT, IMAGE, MENTION, PUBLIC)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def has_any(c: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(t) for t in terms))


def first_rule(c: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """The value of the first rule that holds."""
    out = F
    for value, terms in rules:
        out = out.when(has_any(c, terms), value)
    return out.otherwise(default)


def present(*pairs: tuple[Column, str]) -> Column:
    """An array of the names whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in pairs]))


def facts(text: Column, rules: RuleSet = KOREAN, normalize: bool = True) -> Column:
    """X1-X10. STRUCT of eight scalars, additionalChannels, issueTags, normalizedText, extractionVersion.

    Null counts as ''. Whose description it is plays no part. ``normalize=False`` takes the text to be in NFKC already.
    """
    base = F.coalesce(text, F.lit(""))
    t = F.lower(F.regexp_replace(nfkc(base) if normalize else base, r"^[\s\x{00A0}\x{3000}]+|[\s\x{00A0}\x{3000}]+$", ""))

    def hits(t: Column) -> Column:
        media = present(*[(has_any(t, terms), v) for v, terms in rules.medium])
        if rules.medium_pattern:
            value, pattern = rules.medium_pattern
            media = F.array_distinct(F.concat(media, present((t.rlike(pattern), value))))
        flags = {"sexual": rules.sexual, "insult": rules.insult, "image": rules.image, "mention": rules.mention, "public": rules.public}
        firsts = {"relationship": rules.relationship, "context": rules.context, "repetition": rules.repetition, "reached": rules.reached}
        return F.struct(
            t.alias("t"), media.alias("media"), *[has_any(t, v).alias(k) for k, v in flags.items()], *[first_rule(t, v, "unknown").alias(k) for k, v in firsts.items()]
        )

    def medium(h: Column) -> Column:
        return F.struct(h.alias("h"), F.coalesce(F.get(h["media"], F.lit(0)), F.lit("unknown")).alias("medium"))

    def recipient(m: Column) -> Column:
        h, med = m["h"], m["medium"]
        to = (
            F.when(h["mention"], "mention").when(med == "bank_transfer", "bank_account").when(h["public"], "public_post")
            .when(med.isin(ACCOUNT_MEDIA), "direct_account").otherwise("unknown")
        )
        return F.struct(h.alias("h"), med.alias("medium"), to.alias("recipient"))

    def result(r: Column) -> Column:
        h, med, to = r["h"], r["medium"], r["recipient"]
        expression = F.when(h["image"], "sexual_image").when(h["sexual"] & h["insult"], "insult_with_sexual_terms").when(h["sexual"], "sexual_text").otherwise("other")
        tags = present(
            (~med.isin("unknown", "direct_delivery"), "통신매체"), (h["reached"] == "yes", "도달"), (h["sexual"], "성적표현"), (h["context"] == "conflict", "분노"),
            ((med == "sns_mention") | (to == "mention"), "멘션"), (h["repetition"] == "once", "단발성"), (h["repetition"] == "repeated", "반복성"),
        )
        values = [med, F.when(h["image"], "image").otherwise("text"), to, h["reached"], h["relationship"], h["context"], expression, h["repetition"]]
        more = F.when(F.size(h["media"]) > 1, F.slice(h["media"], 2, len(rules.medium) + 1)).otherwise(F.array().cast("array<string>"))
        return F.struct(
            *[v.alias(n) for n, v in zip(SCALARS, values)], more.alias("additionalChannels"), tags.alias("issueTags"), h["t"].alias("normalizedText"),
            F.lit(rules.version).alias("extractionVersion"),
        )

    return let(let(let(let(t, hits), medium), recipient), result)


def public_facts(c: Column) -> Column:
    """R24. Facts as they may be shown: without the text."""
    return c.dropFields("normalizedText")


def with_defaults(c: Column) -> Column:
    """R16. Stored facts with blanks filled: unknown, text, other."""
    scalars = [F.coalesce(F.nullif(c[f], F.lit("")), F.lit(DEFAULTS[f])).alias(f) for f in SCALARS]
    empty = F.array().cast("array<string>")
    return F.struct(*scalars, *[F.coalesce(c[f], empty).alias(f) for f in ("additionalChannels", "issueTags")])


def is_known(c: Column) -> Column:
    return F.coalesce(~c.isin("", "unknown", "other"), F.lit(False))


def jaccard_percent(a: Column, b: Column) -> Column:
    """R9. Two empty sets give 0."""
    a, b = (F.coalesce(x, F.array().cast("array<string>")) for x in (a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, half_up(F.try_divide(F.size(F.array_intersect(a, b)) * F.lit(100.0), union))).otherwise(F.lit(0).cast("bigint"))


def compare_facts(query: Column, other: Column) -> Column:
    """R8, R9. STRUCT<factScore, issueScore, comparableCount, matchedFacts, differentFacts>.

    A field unknown on either side isn't compared. Nothing to compare, or the message form alone, scores 0.
    """
    sides = F.struct(query.alias("q"), other.alias("o"))

    def pairs(x: Column) -> Column:
        every = F.array(*[F.struct(F.lit(f).alias("field"), x["q"][f].alias("queryValue"), x["o"][f].alias("precedentValue")) for f in SCALARS])
        both = F.filter(every, lambda p: is_known(p["queryValue"]) & is_known(p["precedentValue"]))
        return F.struct(both.alias("both"), jaccard_percent(x["q"]["issueTags"], x["o"]["issueTags"]).alias("issue"))

    def scored(x: Column) -> Column:
        both, n = x["both"], F.size(x["both"])
        same = F.filter(both, lambda p: p["queryValue"] == p["precedentValue"])
        different = F.filter(both, lambda p: p["queryValue"] != p["precedentValue"])
        only_form = (n == 1) & (F.get(both, F.lit(0))["field"] == "messageForm")
        score = F.when((n == 0) | only_form, F.lit(0).cast("bigint")).otherwise(half_up(F.try_divide(F.size(same) * F.lit(100.0), n)))
        return F.struct(score.alias("factScore"), x["issue"].alias("issueScore"), n.cast("bigint").alias("comparableCount"), same.alias("matchedFacts"), different.alias("differentFacts"))

    return let(let(sides, pairs), scored)


def focus(case_name: Column, normalize: bool = True) -> Column:
    """R12. peripheral before mixed before focused (also where the target is absent)."""
    base = F.coalesce(case_name, F.lit(""))

    def kind(name: Column) -> Column:
        target = name.contains(TARGET)
        return F.when(target & has_any(name, PERIPHERAL), "peripheral").when(target & has_any(name, ["·", "(병합)", ","]), "mixed").otherwise("focused")

    return let(without_space(nfkc(base) if normalize else base), kind)


def focus_penalty(c: Column) -> Column:
    """R13."""
    return F.when(c == "peripheral", PENALTY["peripheral"]).when(c == "mixed", PENALTY["mixed"]).otherwise(0).cast("bigint")


def is_target_case(case_name: Column, normalize: bool = True) -> Column:
    """F1, F10. White space isn't collapsed here, as in the search gate."""
    base = F.coalesce(case_name, F.lit(""))
    return (nfkc(base) if normalize else base).contains(TARGET)


def is_relevant(text: Column, normalize: bool = True) -> Column:
    base = F.coalesce(text, F.lit(""))
    return let(without_space(nfkc(base) if normalize else base), lambda t: has_any(t, RELEVANCE))


def is_enumeration(text: Column, normalize: bool = True) -> Column:
    """X11. The statute's own list of forms."""
    base = F.coalesce(text, F.lit(""))


    def listed(t: Column) -> Column:
        return has_any(t, STATUTE_CONTEXT) & (reduce(lambda a, b: a + b, (t.contains(f).cast("int") for f in LISTED_FORMS)) >= 4)

    return let(without_space(nfkc(base) if normalize else base), listed)


def order_kind(text: Column, normalize: bool = True) -> Column:
    """X13. civil, then multiple if more than one family of orders, else the family; other for none and for ''."""
    base = F.coalesce(text, F.lit(""))
    return let(squeeze(nfkc(base) if normalize else base), _order_kind)


def _order_kind(t: Column) -> Column:
    m = {k: t.rlike(p) for k, p in ORDER_PATTERNS.items()}
    families = [m["remand"], m["final_appeal"] | m["appeal"], m["prosecution"], m["acquitted"], m["sentenced"]]
    n = reduce(lambda a, b: a + b, (x.cast("int") for x in families))
    return (
        F.when(m["civil"], "civil").when(n > 1, "multiple").when(m["remand"], "remand").when(m["final_appeal"], "final_appeal_dismissed")
        .when(m["appeal"], "appeal_dismissed").when(m["acquitted"], "acquitted").when(m["sentenced"] & m["reversed"], "reversed_and_sentenced")
        .when(m["sentenced"], "sentenced").otherwise("other")
    )

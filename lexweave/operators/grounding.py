"""Validators of generated texts against what they cite."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Wording that foretells or decides a case.
PREDICTIONS = [r"고소\s*(가능|할\s*수)", "신고.{0,8}(처벌|가능)", "유죄.{0,8}(가능|확률|될)", "무죄.{0,8}(가능|확률)", r"처벌.{0,8}(가능|예상|될\s*수)", r"사용자\s*사건", r"이\s*사례.{0,12}(가능|성립|처벌)"]
VERDICTS = [
    r"해당(합니다|한다|됩니다|된다|하는\s*것으로|될\s*(것|가능))",
    r"성립(합니다|한다|하는|할\s*(것|가능|수)|될)",
    r"충족(합니다|한다|하는\s*것으로|됩니다)",
    r"처벌(받습니다|받게|될\s*(것|가능)|이\s*예상)",
    r"(유죄|무죄|기소|고소|신고).{0,10}(가능성|확률|예상|될\s*것|하면\s*됩니다)",
    r"(승소|패소|형량|양형).{0,6}(예상|가능|은\s*\d)",
    r"범죄가\s*(됩니다|된다|아닙니다)",
]
READER = r"(회원님|귀하|당신|의뢰인|사용자)\s*(의)?\s*(사건|상황|경우)?[^.]{0,20}(해당|성립|충족|처벌|유죄|무죄)"
ELEMENTS = ["purpose", "medium", "expression", "reached"]


def matches_any(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (c.rlike(p) for p in patterns))


def has_exactly(json: Column, keys: list[str]) -> Column:
    """S17. A JSON object with these keys and no other."""
    return F.coalesce(F.array_sort(F.json_object_keys(json)) == F.array(*[F.lit(k) for k in sorted(keys)]), F.lit(False))


def json_type(v: Column) -> Column:
    """Type of a JSON value (VARIANT): STRING, ARRAY, OBJECT or another; null where there is none."""
    return F.regexp_extract(F.schema_of_variant(v), r"^(\w+)", 1)


def _item(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def _items(v: Column, key: str) -> Column:
    """The raw items of a list; null where it is none."""
    got = _item(v, key)
    return F.when(json_type(got) == "ARRAY", F.try_variant_get(got, "$", "array<variant>"))


def _text(v: Column) -> Column:
    """A JSON string without white space around it; null for every other type."""
    return F.when(json_type(v) == "STRING", F.regexp_replace(F.try_variant_get(v, "$", "string"), "(?U)^[\\s\\uFEFF]+|[\\s\\uFEFF]+$", ""))


def validate_summary(payload: Column, allowed: Column) -> Column:
    """V1. STRUCT<sentences, error>: all or nothing.

    ``payload`` is JSON text, ``allowed`` the ids that may be cited. Null and broken JSON are an error; values are judged
    by their JSON types, so numbers and objects are no texts and no ids.
    """
    v = F.try_parse_json(payload)
    items = _items(v, "sentences")
    ids = lambda i: F.transform(_items(i, "paragraphIds"), lambda p: F.when(json_type(p) == "STRING", F.try_variant_get(p, "$", "string")))
    sentences = F.transform(items, lambda i: F.struct(_text(_item(i, "text")).alias("text"), F.array_distinct(ids(i)).alias("paragraphIds")))
    well = F.forall(items, lambda i: has_exactly(F.to_json(i), ["paragraphIds", "text"]))
    neutral = F.forall(sentences, lambda s: F.coalesce((F.length(s["text"]).between(1, 500)) & ~matches_any(s["text"], PREDICTIONS), F.lit(False)))
    cited = F.forall(sentences, lambda s: F.coalesce(F.size(s["paragraphIds"]).between(1, 5), F.lit(False)))
    known = F.forall(sentences, lambda s: F.forall(s["paragraphIds"], lambda p: F.coalesce(F.array_contains(allowed, p), F.lit(False))))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    error = (
        F.when(no(has_exactly(F.to_json(v), ["sentences"])), "FORM").when(no(F.size(items).between(1, 3)), "SENTENCE_COUNT").when(no(F.size(allowed) > 0), "NO_PARAGRAPHS")
        .when(no(well), "SENTENCE_FORM").when(no(neutral), "NOT_NEUTRAL").when(no(cited), "CITATION_COUNT").when(no(known), "UNKNOWN_PARAGRAPH")
    )
    return F.struct(F.when(error.isNull(), sentences).alias("sentences"), error.alias("error"))


def is_neutral(c: Column, about_precedent: bool = False) -> Column:
    """V3. Notes on a precedent may say what its court did; nothing may speak of the reader's case."""
    free = ~c.rlike(READER)
    return free if about_precedent else free & ~matches_any(c, VERDICTS)


def validate_analysis(payload: Column, allowed: Column, elements: list[str] = ELEMENTS) -> Column:
    """V2, W6, Q9. STRUCT<overview, elementNotes, precedentNotes, nextSteps, dropped>: bad items go, nothing fails.

    Each item is judged by itself and by its JSON type: one that is malformed costs no other. The first good note of an
    element stays. ``dropped`` names the list of each item that went: texts for what they say (blank, too long and
    other types than strings go without a word), notes for anything.
    """
    v = F.try_parse_json(payload)
    none = lambda kind: F.array().cast(f"array<{kind}>")
    sized = lambda t, most: F.when(F.length(t).between(1, most), t)

    def plain(key: str, most: int, n: int) -> tuple[Column, Column]:
        good = F.coalesce(F.array_compact(F.transform(_items(v, key), lambda i: sized(_text(i), most))), none("string"))
        return F.slice(F.filter(good, lambda t: is_neutral(t)), 1, n), F.size(F.filter(good, lambda t: ~is_neutral(t)))

    def notes(key: str, name: str, fits) -> tuple[Column, Column]:
        kind = f"struct<{name}:string,text:string>"
        named = lambda i: F.when(json_type(_item(i, name)).isin("STRING", "BIGINT", "DECIMAL", "DOUBLE", "BOOLEAN"), F.try_variant_get(i, f"$.{name}", "string"))
        read = F.transform(_items(v, key), lambda i: F.struct(named(i).alias(name), sized(_text(_item(i, "text")), 400).alias("text")))
        read = F.coalesce(read, none(kind))
        return F.filter(read, lambda n: F.coalesce(fits(n) & n["text"].isNotNull(), F.lit(False))), F.size(read)

    overview, bad_overview = plain("overview", 400, 4)
    steps, bad_steps = plain("nextSteps", 200, 5)
    el, n_el = notes("elementNotes", "id", lambda n: n["id"].isin(elements) & is_neutral(n["text"]))
    ids = F.transform(el, lambda n: n["id"])
    el_kept = F.filter(el, lambda n, i: F.array_position(ids, n["id"]) == i + 1)
    pr, n_pr = notes("precedentNotes", "caseNumber", lambda n: F.array_contains(allowed, n["caseNumber"]) & is_neutral(n["text"], True))
    dropped = F.concat(
        F.array_repeat(F.lit("overview"), bad_overview), F.array_repeat(F.lit("elementNote"), n_el - F.size(el_kept)), F.array_repeat(F.lit("precedentNote"), n_pr - F.size(pr)),
        F.array_repeat(F.lit("nextStep"), bad_steps),
    )
    dropped = F.when(json_type(v) == "OBJECT", dropped).otherwise(F.array(F.lit("payload")))
    return F.struct(overview.alias("overview"), el_kept.alias("elementNotes"), F.slice(pr, 1, 6).alias("precedentNotes"), steps.alias("nextSteps"), dropped.alias("dropped"))


def client_analysis(payload: Column, allowed: Column, elements: list[str] = ELEMENTS) -> Column:
    """V5. What a client shows of an analysis: STRUCT<overview, elementNotes, precedentNotes, nextSteps>, read again item by
    item; null if there is none. Texts are trimmed and not blank; notes name a known element or a case of the results."""
    v = F.try_parse_json(payload)
    texts = lambda key, n: F.slice(F.filter(F.array_compact(F.coalesce(F.transform(_items(v, key), _text), F.array().cast("array<string>"))), lambda t: t != ""), 1, n)

    def notes(key: str, name: str, known) -> Column:
        named = lambda i: F.when(json_type(_item(i, name)) == "STRING", F.try_variant_get(i, f"$.{name}", "string"))
        read = F.transform(_items(v, key), lambda i: F.struct(named(i).alias(name), _text(_item(i, "text")).alias("text")))
        return F.coalesce(F.filter(read, lambda n: F.coalesce(known(n[name]) & (n["text"] != ""), F.lit(False))), F.array().cast(f"array<struct<{name}:string,text:string>>"))

    out = F.struct(
        texts("overview", 4).alias("overview"), notes("elementNotes", "id", lambda x: x.isin(elements)).alias("elementNotes"),
        notes("precedentNotes", "caseNumber", lambda x: F.array_contains(allowed, x)).alias("precedentNotes"), texts("nextSteps", 5).alias("nextSteps"),
    )
    return F.when(json_type(v) == "OBJECT", out)


def element_mentions(facts: Column) -> Column:
    """X16. What a description says of each element: present, absent or unclear (the purpose is always unclear)."""
    mention = {
        "purpose": F.lit("unclear"),
        "medium": F.when(F.coalesce(F.nullif(facts["medium"], F.lit("")), F.lit("unknown")) != "unknown", "present").otherwise("unclear"),
        "expression": F.when(F.coalesce(F.nullif(facts["expressionType"], F.lit("")), F.lit("other")) != "other", "present").otherwise("unclear"),
        "reached": F.when(facts["reachedRecipient"] == "yes", "present").when(facts["reachedRecipient"] == "no", "absent").otherwise("unclear"),
    }
    return F.array(*[F.struct(F.lit(e).alias("id"), mention[e].alias("mention")) for e in ELEMENTS])


# Labels and quotes of the statute's elements, and the words for what a description says of them.
ELEMENT_TEXTS = {
    "purpose": ("성적 욕망을 유발하거나 만족시킬 목적", "자기 또는 다른 사람의 성적 욕망을 유발하거나 만족시킬 목적으로"),
    "medium": ("통신매체를 통한 전달", "전화, 우편, 컴퓨터, 그 밖의 통신매체를 통하여"),
    "expression": ("성적 수치심이나 혐오감을 일으키는 표현", "성적 수치심이나 혐오감을 일으키는 말, 음향, 글, 그림, 영상 또는 물건을"),
    "reached": ("상대방에게 도달", "상대방에게 도달하게 한"),
}
MEDIUM_LABELS = {"bank_transfer": "송금메모", "kakao": "카카오톡", "game_chat": "게임 채팅", "sns_mention": "SNS 멘션", "direct_delivery": "직접 전달", "digital_message": "디지털 메시지"}
EXPRESSION_LABELS = {"insult_with_sexual_terms": "성적인 비하·욕설 표현", "sexual_text": "성적인 글 표현", "sexual_image": "성적인 이미지"}
PURPOSE_EVIDENCE = "입력만으로는 알 수 없는 요건입니다. 법원이 여러 사정을 종합해 판단합니다."
MEDIUM_UNKNOWN, EXPRESSION_UNKNOWN = "입력에서 전달 수단을 확인하지 못했습니다.", "입력에서 성적 표현에 관한 언급을 확인하지 못했습니다."
REACHED = {"yes": "입력에서 상대방이 내용을 확인했다는 언급을 찾았습니다.", "no": "입력에서 상대방에게 전달되지 않았다는 언급을 찾았습니다.", "": "입력에서 도달 여부를 확인하지 못했습니다."}


def mapped_elements(facts: Column) -> Column:
    """X16. ARRAY of STRUCT<id, label, statuteQuote, mention, evidence>: each element with its definition and what is said of it."""

    def named(c: Column, labels: dict[str, str]) -> Column:
        table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
        return F.concat(F.lit("입력에서 "), F.coalesce(F.try_element_at(table, c), c), F.lit("을 확인했습니다."))

    def evidence(m: Column) -> Column:
        i, known = m["id"], m["mention"] == "present"
        return (
            F.when(i == "purpose", PURPOSE_EVIDENCE).when(i == "medium", F.when(known, named(facts["medium"], MEDIUM_LABELS)).otherwise(MEDIUM_UNKNOWN))
            .when(i == "expression", F.when(known, named(facts["expressionType"], EXPRESSION_LABELS)).otherwise(EXPRESSION_UNKNOWN))
            .otherwise(F.when(known, REACHED["yes"]).when(m["mention"] == "absent", REACHED["no"]).otherwise(REACHED[""]))
        )

    text = F.create_map(*[x for e, (label, quote) in ELEMENT_TEXTS.items() for x in (F.lit(e), F.struct(F.lit(label).alias("label"), F.lit(quote).alias("quote")))])
    return F.transform(
        element_mentions(facts),
        lambda m: F.struct(m["id"].alias("id"), F.try_element_at(text, m["id"])["label"].alias("label"), F.try_element_at(text, m["id"])["quote"].alias("statuteQuote"), m["mention"].alias("mention"), evidence(m).alias("evidence")),
    )


def analysis_schema(case_numbers: list[str], elements: list[str] = ELEMENTS) -> dict:
    """U3. The JSON schema an adapter's answer has to follow: ids are given, so no other can come back."""
    text = lambda n: {"type": "string", "minLength": 1, "maxLength": n}
    many = lambda items, n: {"type": "array", "maxItems": n, "items": items}
    named = lambda key, kind: {"type": "object", "additionalProperties": False, "required": [key, "text"], "properties": {key: kind, "text": text(400)}}
    case = {"type": "string", "enum": list(case_numbers)} if case_numbers else {"type": "string"}
    parts = {"overview": many(text(400), 4), "elementNotes": many(named("id", {"type": "string", "enum": list(elements)}), 4), "precedentNotes": many(named("caseNumber", case), 6), "nextSteps": many(text(200), 5)}
    return {"type": "object", "additionalProperties": False, "required": list(parts), "properties": parts}


def unknown_citations(summaries: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """V4, J8. (precedent_id, paragraph_id) cited, with repeats, but not there."""
    cited = summaries.select("precedent_id", F.explode("sentences").alias("s")).select("precedent_id", F.explode("s.paragraph_ids").alias("paragraph_id"))
    return cited.where(F.col("paragraph_id").isNotNull()).join(paragraphs.select("precedent_id", "paragraph_id").distinct(), ["precedent_id", "paragraph_id"], "left_anti")


def analysis_input(statute: Column, elements: Column, description: Column, rows: Column) -> Column:
    """V7. The document an analysis adapter is given, as JSON."""
    return F.to_json(F.struct(statute.alias("statute"), elements.alias("elements"), description.alias("description"), rows.alias("precedents")))

"""The suffix automaton against brute force; pages of each kind on both sides of the line; edge cases."""

import random

import pytest

from lexweave.llm import stuffing as stuffing_module
from lexweave.llm.stuffing import PHRASE_SHARE, TWICE_SHARE, SuffixAutomaton, measure, stuffing

CLAUSE = "피고인은 2019. 12. 14. 은솔시 물길동의 독서실에서 피해자에게 사과를 요구하며 글을 보냈고, 원심은 증거가 뚜렷한 점을 불리한 사정으로 보았다. "
ENGLISH = "The appellate panel found that the access log supported the finding of the trial judge, and only two of them saw the disputed line. "
STUFFED = [
    "형사상담 순위 합의금 비용 벌금계산 24시 채팅고소 전국 소장작성 1위 탄원서 즉시상담 " * 3, "판례검색\n사건조회\n판례검색\n판례검색\n사건조회\n" * 5, "형사상담비교벌금계산비교판례검색비교성범죄전문다운로드변호사추천무료",
    "국선신청 예약을 찾으시면 역시 국선신청 예약입니다. 국선신청 예약은 국선신청 예약이 답입니다. 국선신청 예약 하면 국선신청 예약, 국선신청 예약이라고 합니다. " * 3,
    "선물용 보이스펜 품번 5601 대용량 문서파쇄기 49,900원 미니 휴대폰케이스 품번 6969 국내산 서류가방 29,900원 " * 2, "#녹음기 #만년필 #수험서 #형사상담 #문서파쇄기 #독서대 #정장 #메모리카드 #고소장 #보안필름",
    '<a href="http://a.invalid/62255">벌금계산 예약</a><br><a href="https://b.test/p/49417">내용증명 비교</a><br>' * 3, "주소창에 abc22 . test 클릭 www de-mark . invalid / fgguide . example 클릭 hxxp://quick42 . invalid\n" * 2,
    "court fine calculator download is the best court fine calculator download. court fine calculator download because court fine calculator download means court fine calculator download. " * 2,
    "mini briefcase 33.90 EUR - 2-pack desk lamp mini - limited law book black - premium fountain pen 43.90 EUR - A4 paper shredder item 5311", CLAUSE + "#반성문 항소이유서 채팅고소 #변호사추천 소장작성 사건조회 " * 9,
]
REPORTS = [
    CLAUSE * 3, ENGLISH * 3, ENGLISH * 90, "차례\n" + "".join(f"제{i}장 고의의 판단 기준 ····· {7 * i}\n" for i in range(1, 15)), "증거의 요지\n" + "1. 피해자 D에 대한 접속 기록\n1. 참고인 F에 대한 수사보고\n" * 8,
    "참조판례는 다음과 같다. " + "은솔지방법원 2019. 11. 26. 선고 2015고단4731 판결, " * 12, "목적은 통신사 회신로 살피며, 목적을 다투는 피고인 A은 우발적으로 벌어진 점을 든다. 목적은 접속 기록로 살피며, 목적을 다투는 피고인은 초범인 점을 든다. " * 4,
    "범죄일람표\n" + "순번 1 2018. 5. 9 03:50 가온시 사무실 TopiaRoom 사과를 요구하며 욕설을 전송하였\n" * 6, "".join(f"- https://www.onbit{i}.example/tag/31 : {CLAUSE}\n" for i in range(5)), CLAUSE * 2 + "참고: https://a.test/view?no=1\n참고: https://b.test/p/2",
    CLAUSE * 2 + "형사상담 순위 합의금 비용 벌금계산 전국 소장작성 무료 탄원서 할인",
]


GERMAN = "Das Landgericht hat die Berufung des Angeklagten verworfen, weil die Feststellungen des Amtsgerichts zu den Nachrichten an die Zeugin von den Protokollen gestützt werden. Der Angeklagte hatte in der Nacht mehrere Nachrichten geschickt, und er hat den Inhalt vor Gericht nicht bestritten. Für die Höhe der Strafe war es von Bedeutung, dass er bis zu diesem Tag nie vor einem Richter stand und sich bei der Zeugin in einem Brief entschuldigt hat. "
SPANISH = "El tribunal de apelación confirmó la sentencia porque los registros de la empresa de telefonía apoyaban el relato de la víctima. El acusado envió varios mensajes en la noche del tres de mayo y no negó su contenido ante el juez. La defensa alegó que no había intención de causar daño, pero la sala entendió que las palabras usadas y la hora de los envíos decían lo contrario. "
FRENCH = "La cour a confirmé le jugement parce que les relevés de la société de téléphonie appuient le récit de la victime. Le prévenu a envoyé plusieurs messages dans la nuit du trois mai et il n'a pas nié leur contenu devant le juge. "
RUSSIAN = "Суд апелляционной инстанции оставил приговор без изменения, так как записи оператора подтвердили показания потерпевшей. Подсудимый в ту ночь отправил ей не одно сообщение и не стал это отрицать. Он был не согласен с тем, как суд оценил его письмо, но ни на одном из заседаний не смог это объяснить. "
JAPANESE = "控訴裁判所は、被告人が深夜に被害者へ繰り返しメッセージを送った事実を認めた。弁護人は送信の意図を争ったが、通信記録の内容から見てその主張を退けるほかないと判断した。量刑については、被告人が反省していることと初犯であることを考慮した。"
CHINESE = "上诉法院认为被告人在深夜多次向被害人发送侮辱性信息的事实已经得到通信记录的证明。辩护人主张被告人没有伤害他人的故意，但是法院根据发送时间和文字内容认定这一主张不能成立。"
PADDED = "lawyer and settlement for fine is consultation was cheap and lawyer for settlement and fine is cheap was consultation and lawyer is settlement for consultation and fine was cheap for lawyer and settlement is fine and consultation for lawyer was cheap and settlement for fine. "
FOREIGN_STUFFED = ["Rechtsanwalt günstig Scheidung Kosten Abfindung Beratung Kündigung Strafe Verkehrsrecht Berlin Rechtsanwalt günstig Scheidung Kosten " * 3, "abogado barato divorcio precio indemnización consulta gratis Madrid abogado penalista multa recurso " * 4, "弁護士 無料相談 慰謝料 離婚 格安 弁護士 相談 示談金 即日 全国対応 " * 4]


@pytest.mark.parametrize("page", ["the number of messages the access log #purpose the chat export a clean record the lack of a settlement sincere remorse delivery of the message no fee top 10 near me. " * 2, "The chat room held 50 members, and only 15 of them saw the disputed line. " + "the screen capture intent delivery of the message #the chat export the seized phone a clean record near me " * 4])
def test_english_key_words_with_articles(page):
    assert share(page) > 0.55


@pytest.mark.parametrize("page", [GERMAN, SPANISH, FRENCH * 2, RUSSIAN, JAPANESE, CHINESE])
@pytest.mark.parametrize("times", [1, 4])
def test_prose_of_other_languages(page, times):
    assert share(page * times) < 0.45


@pytest.mark.parametrize("page", [PADDED, PADDED * 20, *FOREIGN_STUFFED])
def test_padded_and_foreign_key_words(page):
    assert share(page) > 0.55


@pytest.mark.parametrize("page", ["목적 예약은 목적 예약이 답입니다. 목적 예약 문의는 목적 예약에서 합니다. 목적 예약을 찾으시면 역시 목적 예약입니다. 목적 예약 하면 목적 예약, 목적 예약이라고 합니다. ", "the age of the parties discount is the best the age of the parties discount."])
def test_short_key_phrases_twice_a_sentence(page):
    assert share(page) > 0.55


def test_once_repeated_phrase_in_prose():
    assert share("원심은 범행 뒤의 정황을 유리한 사정으로, 범행 뒤의 정황을 불리한 사정으로 보았다. 수치심을 일으키는 글인지는 표현의 내용, 맥락, 관계, 횟수를 두루 살펴 정한다.") < 0.45
    assert share("A fine was imposed after the judge weighed the age of the parties against the age of the parties.") < 0.45
    assert share("The appellate panel found that the seized phone and the seized phone supported the finding of the trial judge.") < 0.45


def share(text):
    n, *parts, covered = measure(text, {})
    assert n == len(text) and sum(parts) <= n and min(parts) >= 0 and 0 <= covered <= n
    return sum(parts) / n if n else 0.0


@pytest.mark.parametrize("text", STUFFED)
def test_stuffed(text):
    assert share(text) > 0.55


@pytest.mark.parametrize("text", REPORTS)
def test_reports(text):
    assert share(text) < 0.45


@pytest.mark.parametrize("n", [5, 9, 11, 12, 40])
def test_many_key_phrases_in_turn(n):
    """However small a part of the page each phrase is, its own sentences are full of it."""
    phrases = [f"{'가나다라마바사아자차'[i % 10]}{'거너더러머버서어저처'[i // 10]}신청 예약센터" for i in range(n)]
    page = " ".join(f"{p}의 장점은 {p}입니다." for _ in range(5) for p in phrases)
    assert share(page) > 0.9 and share(page + " " + CLAUSE * (len(page) // len(CLAUSE) * 2)) < 0.45


@pytest.mark.parametrize("n", [5, 15, 25, 80])
def test_many_key_phrases_in_one_sentence_each(n):
    """A phrase that comes twice, in one sentence, fills it on a page of any length."""
    korean = " ".join(f"{chr(0xAC00 + 37 * i)}신청 {chr(0xB000 + 31 * i)}센터의 장점은 {chr(0xAC00 + 37 * i)}신청 {chr(0xB000 + 31 * i)}센터입니다." for i in range(n))
    english = " ".join("{0} loan{0} quote{0} is the {0} loan{0} quote{0}.".format(f"{chr(97 + i % 26)}{chr(97 + i // 26)}x") for i in range(n))
    for page in (korean, english):
        assert share(page) > 0.9 and measure(page, {})[4] > 0.5 * len(page)  # and is covered by what occurs again
        assert share(page + " " + CLAUSE * (len(page) // len(CLAUSE) * 2 + 2)) < 0.45


@pytest.mark.parametrize("gap", [" ", ", ", " " * 10, " \u2022 \u2022 \u2022 "])
def test_key_phrases_with_any_separator(gap):
    phrase = gap.join(("국선", "예약", "상담"))
    assert share("".join(f"{phrase}은 {a}. " for a in ("열었다", "닫았다", "싸다", "온다"))) > 0.55


def test_key_phrases_in_sentences_and_in_bare_runs():
    """What is listed in a bare run and comes once more in a sentence is repeated; prose beside the same list isn't."""
    phrases = [f"{chr(0xAC00 + 37 * i)}신청 {chr(0xB000 + 31 * i)}센터" for i in range(12)]
    tags = " ".join(phrases) + "\n"
    page = "".join(f"{p}를 보세요.\n" for p in phrases)
    assert share(page) == 0 and share(tags * 2 + page) > 0.9
    assert share(CLAUSE * 9 + tags * 2) < 0.45


def brute_repeats(words, ends, known, flags, counts, runs, starts, sentences, sizes):
    """What _repeats gives, from all substrings of the stems between marks."""
    ran, gone = ({w for r in runs for w in range(*r)}, {c for i, j in runs for c in range(starts[i], starts[j])})
    parts, before = [], None
    for i, a in enumerate(starts[:-1]):
        k = max((k for k, (x, _) in enumerate(sentences) if x <= a), default=0)
        if not known[i] or (flags[i] and ends[i] <= 0):
            before = None
            continue
        if before != k:
            parts.append((k, []))
        parts[-1][1].append(i)
        before = k if ends[i] <= 0 else None
    found = {}
    for k, p in parts:
        for x in range(len(p)):
            for y in range(x, len(p)):
                found.setdefault(tuple(known[i] for i in p[x : y + 1]), []).append((k, p[x], p[y]))
    keyed, covered = set(), set()
    for phrase, at in found.items():
        outside = [(k, i, j) for k, i, j in at if j not in ran]
        if len(at) < 2 or not outside:
            continue
        chars = {c for _, i, j in outside for c in range(starts[i] + words[i].find(known[i]), starts[j] + words[j].find(known[j]) + len(known[j]))} - gone
        inside, twice = {k for k, *_ in outside}, 2 * len(outside) >= 3 * len({k for k, *_ in outside})
        covered |= chars
        if twice or len(at) >= 3:
            least = (TWICE_SHARE if twice else PHRASE_SHARE)[all(map(str.isascii, phrase))] if len(at) >= 3 else PHRASE_SHARE[1]
            keyed |= inside if len(chars) >= least * sum(sizes[k] for k in inside) else set()
    return keyed, len(covered)


def test_repeats_against_brute_force(monkeypatch):
    rng, kept, seen = random.Random(7), stuffing_module._repeats, []

    def both(*args):
        seen.append((kept(*args), brute_repeats(*args)))
        return seen[-1][0]

    monkeypatch.setattr(stuffing_module, "_repeats", both)
    for _ in range(1500):
        some = rng.sample("국선 예약 상담 비용 벌금 사건 court fine quick loan 24시 순위".split(), rng.randint(2, 9))
        out = []
        for _ in range(rng.randint(1, 40)):
            key = rng.choice(some) + rng.choice(["", "", "", "를", "의", "입니다", "-"]) + rng.choice([" ", " ", " ", ", ", " · ", "   •   "])
            out.append(key if rng.random() < 0.8 else rng.choice(["원심은 ", "그리고 ", "seen ", "the ", "보았다. ", "and ", ".\n", ". "]))
        if rng.random() < 0.4:
            out.insert(rng.randint(0, len(out)), " ".join(rng.choice(some) for _ in range(rng.randint(8, 30))) + rng.choice(["\n", " ", "를 "]))
        share("".join(out) + rng.choice(["", CLAUSE * 6]))
    assert all(got == want for got, want in seen) and sum(bool(got[0]) for got, _ in seen) > 50


def test_key_phrase_partly_in_bare_runs():
    assert share("접속 기록 24시 하면 접속 기록 24시, 접속 기록 24시이라고 합니다. 접속 기록 24시을 찾으시면 역시 접속 기록 24시입니다.") > 0.55


def test_suffix_automaton_counts():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.choice(["a", "b", "c", "", ""][: rng.choice((3, 5))]) for _ in range(rng.randint(1, 30))]
        subs = {}
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                if "" not in s[i:j]:  # which divides
                    subs[tuple(s[i:j])] = subs.get(tuple(s[i:j]), 0) + 1
        got = {tuple(s[e - n : e]): c for e, n, c in SuffixAutomaton(s).repeated(2)}
        assert all(subs[k] == c for k, c in got.items())
        # every left-maximal repeated substring is there
        for k, c in subs.items():
            before = {(s[i - 1] or None) if i else None for i in range(len(s)) if tuple(s[i : i + len(k)]) == k}
            if c >= 2 and (len(before) > 1 or None in before):
                assert got[k] == c
    assert len(SuffixAutomaton(list(range(1, 20_001))).next) <= 40_001


def test_table(spark):
    rows = [(1, STUFFED[0]), (1, STUFFED[0]), (2, None), (3, ""), (4, " \n "), (None, REPORTS[0]), (5, STUFFED[3] * 200), (6, "https://a.test/x")]
    df = spark.createDataFrame([(*r, 7, "z") for r in rows], "doc_id bigint, text string, n_chars int, stuffed_share string")
    got = stuffing(df, "doc_id", "text").collect()
    found = sorted(r.doc_id for r in got if r.stuffed_share > 0.5)
    assert len(got) == len(rows) and found == [1, 1, 5, 6] and all(r.stuffed_share <= 1 for r in got)
    assert stuffing(df.limit(0), "doc_id", "text").count() == 0

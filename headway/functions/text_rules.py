"""Keyword and pattern rules over question, answer and query logs, as column expressions."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: keyword groups, first match wins
QUERY_TYPES = [
    ("time_series", ["시간대별", "월별", "일별", "년도별", "시간", "언제", "시간당", "분기별"]),
    ("aggregation", ["개수", "총", "평균", "최대", "최소", "합계", "top", "상위", "하위"]),
    ("spatial", ["근처", "주변", "거리", "위치", "좌표", "km", "m", "지역", "구", "동"]),
    ("complex", ["비교", "분석", "관계", "연관", "영향", "상관관계", "패턴"]),
]
ANSWER_TYPES = [
    ("benefits", ["장점", "효과", "이점", "혜택", "좋은점", "도움"]),
    ("definition", ["정의는", "무엇인가", "개념", "의미", "뜻", "란 무엇"]),
    ("procedure", ["방법", "절차", "과정", "단계", "어떻게", "방식"]),
    ("examples", ["사례", "예시", "예", "실제", "도입", "적용"]),
    ("comparison", ["차이", "비교", "다른점", "구별", "vs"]),
    ("comprehensive", ["포괄적", "전체적", "종합적", "자세히", "상세히", "전반적"]),
    ("problem_solution", ["문제", "해결", "개선", "최적화", "향상"]),
    ("characteristics", ["특징", "구성", "요소", "구조", "특성"]),
]
# fixed values: wording normalised in questions, in this order
PHRASES = [
    (r"몇\s*개", "개수"),
    (r"얼마나\s*많이", "개수"),
    (r"어느\s*지역", "어떤 구"),
    (r"어떤\s*노선", "어떤 버스"),
    (r"언제", "어떤 시간"),
    (r"어디", "어떤 곳"),
    (r"누가", "어떤 사람"),
    (r"왜", "이유"),
    (r"어떻게", "방법"),
]
# fixed values: words and hints of traffic questions, day names
TRAFFIC_WORDS = ["교통량", "통행량", "이용량", "승객", "승차", "이용객"]
MONTH_HINT = " (시계열 데이터에서 해당 월의 승하차 데이터 집계 - station_passenger_history, section_passenger_history 테이블 활용)"
CARD_HINT = " (교통카드 승하차 데이터 기반으로 답변 - station_passenger_history 테이블 활용)"
RELATIVE_DAYS = {"오늘": 0, "어제": -1, "그저께": -2, "내일": 1, "모레": 2}
# fixed values: substitutions per intent for paraphrases
PARAPHRASES = [
    (["정의", "무엇"], [("정의", "개념"), ("무엇인가", "의미")]),
    (["장점", "효과"], [("장점", "이점"), ("효과", "혜택")]),
    (["방법", "어떻게"], [("방법", "방식"), ("어떻게", "어떤 방식으로")]),
]
SHORT_NAME, LONG_NAMES = "DRT", ("수요응답형교통", "demand responsive transport")
# fixed values: marks of a good answer and of a good or bad judgement
STEP_MARKERS = ["1단계", "2단계", "3단계", "4단계"]
ASPECTS = ["개념", "정의", "장점", "효과", "운영", "방식", "정책", "사례"]
GOOD_WORDS = ["관련", "중요", "포함", "설명", "상세", "적합"]
BAD_WORDS = ["무관", "부족", "간접", "제한", "부분"]


def has_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def hits(text: Column, words: list[str]) -> Column:
    return reduce(add, [text.contains(w).cast("int") for w in words])


def first_group(text: Column, groups: list[tuple[str, list[str]]], otherwise: str) -> Column:
    low = F.lower(text)
    return reduce(lambda c, g: c.when(has_any(low, g[1]), g[0]), groups, F).otherwise(otherwise)


def question_query_type(text: Column) -> Column:
    return first_group(text, QUERY_TYPES, "basic")


def question_answer_type(text: Column) -> Column:
    return first_group(text, ANSWER_TYPES, "general")


def rewrite_question(text: Column, today: str, data_from: str, data_to: str, month: str = "2025-07") -> Column:
    """Ordered rewrites: the data month, relative times, wording, then a table hint."""
    day = dt.date.fromisoformat(today)
    year, mon = month.split("-")
    span = f"{year}년 {int(mon)}월 (실제 데이터: {data_from} ~ {data_to})"
    months = [rf"{year}년\s*{int(mon)}월", rf"{year}년\s*{mon}월", rf"{year}\s*{int(mon)}월", rf"{year}-{mon}", rf"{int(mon)}월"]
    yesterday = day - dt.timedelta(days=1)
    named = lambda d: f"{d.year}년 {d.month:02d}월 {d.day:02d}일"
    times = [
        ("오늘", f"{named(day)} ({day})"),
        ("어제", named(yesterday)),
        ("이번달", f"{day.year}년 {day.month}월"),
        ("이번 달", f"{day.year}년 {day.month}월"),
        ("올해", f"{day.year}년"),
        ("이번년도", f"{day.year}년"),
        ("현재", f"현재 ({day})"),
        ("지금", f"현재 ({day})"),
        ("요즘", f"최근 ({day} 기준)"),
    ]
    rules = [(m, span) for m in months] + times + PHRASES
    out = reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, strip(text))
    low = F.lower(out)
    hint = F.when(has_any(low, TRAFFIC_WORDS) & low.contains("월"), MONTH_HINT).when(has_any(low, TRAFFIC_WORDS), CARD_HINT)
    return F.concat(out, F.coalesce(hint, F.lit("")))


def first_of(items: Column, limit: int | None) -> Column:
    return items if limit is None else F.slice(items, 1, limit)


def expand_queries(text: Column, limit: int | None = None) -> Column:
    """The question and its rule-based paraphrases, distinct; all of them, or the first ``limit``."""
    long_form = F.replace(text, F.lit(SHORT_NAME), F.lit(LONG_NAMES[0]))
    chain = F
    for words, swaps in PARAPHRASES:
        said = reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), swaps, text)
        chain = chain.when(has_any(text, words), F.array(text, said, long_form))
    general = F.when(
        text.contains(SHORT_NAME), F.array(text, *[F.replace(text, F.lit(SHORT_NAME), F.lit(n)) for n in LONG_NAMES])
    ).otherwise(F.array(text))
    return first_of(F.array_distinct(chain.otherwise(general)), limit)


def expand_with_keywords(text: Column, keywords: list[str], limit: int | None = None) -> Column:
    """Paraphrases and one variant per keyword, distinct; all of them, or the first ``limit``."""
    extra = [F.concat(F.lit(f"{k}와 관련된 "), text) for k in keywords]
    return first_of(F.array_distinct(F.concat(expand_queries(text), F.array(*extra))), limit)


# every character that counts as white space around a text
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def parse_query_lines(response: Column, original: Column, limit: int | None = None, shortest: int = 10) -> Column:
    """The original and usable distinct lines of a response, bullets and numbers removed."""
    lines = F.transform(F.split(response, "\n"), lambda x: strip(F.regexp_replace(strip(x), r"^[- •·*0-9.)]+", "")))
    usable = F.filter(lines, lambda x: (F.length(x) >= shortest) & (F.lower(x) != F.lower(original)))
    return first_of(F.array_distinct(F.concat(F.array(original), usable)), limit)


def day_word(text: Column) -> Column:
    """The first word of the text that names a day relative to today; NULL without one."""
    return F.nullif(F.regexp_extract(text, "|".join(RELATIVE_DAYS), 0), F.lit(""))


def _last(text: Column, pattern: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1))


def parse_labelled_text(text: Column) -> dict[str, Column]:
    """Label, clamped confidence, reason and keywords of an answer log; later lines win."""
    label = F.coalesce(
        F.upper(_last(text, r"(?mi)^\s*분류:\s*(QUALITATIVE|QUANTITATIVE|MIXED|IRRELEVANT)\s*$")), F.lit("QUALITATIVE")
    )
    said = _last(text, r"(?m)^\s*신뢰도:\s*(.*)$")
    words = F.filter(
        F.transform(F.split(F.coalesce(_last(text, r"(?m)^\s*키워드:\s*(.*)$"), F.lit("")), ","), strip), lambda w: w != ""
    )
    return {
        "label": label,
        "confidence": F.least(F.greatest(F.coalesce(said.try_cast("double"), F.lit(0.5)), F.lit(0.0)), F.lit(1.0)),
        "reason": F.coalesce(strip(_last(text, r"(?m)^\s*근거:\s*(.*)$")), F.lit("LLM 응답 파싱 실패")),
        "keywords": words,
        "needs_sql": label.isin("QUANTITATIVE", "MIXED"),
        "needs_rag": label.isin("QUALITATIVE", "MIXED"),
    }


def parse_score(text: Column) -> Column:
    """Score of the first document, or a guess from good and bad words."""
    found = F.regexp_extract(text, r"문서 1:\s*([0-9]*\.?[0-9]+)", 1)
    good, bad = hits(text, GOOD_WORDS), hits(text, BAD_WORDS)
    guess = F.when(good > bad, 0.7).when(bad > good, 0.3).otherwise(0.5)
    return F.when(found != "", F.least(F.lit(1.0), found.cast("double"))).otherwise(guess)


def answer_confidence(text: Column, has_steps: Column) -> Column:
    total = (
        0.5
        + F.when(F.length(strip(text)) > 100, 0.2).otherwise(0.0)
        + F.when(has_steps, 0.2).otherwise(0.0)
        + F.when(has_any(text, STEP_MARKERS), 0.1).otherwise(0.0)
    )
    return F.least(F.lit(0.95), total)


def multi_answer_confidence(text: Column, has_steps: Column, documents: Column) -> Column:
    aspects = hits(text, ASPECTS)
    total = (
        0.6
        + F.when(documents >= 10, 0.2).when(documents >= 5, 0.1).otherwise(0.0)
        + F.when(F.length(strip(text)) > 500, 0.1).otherwise(0.0)
        + F.when(has_steps, 0.1).otherwise(0.0)
        + F.when(has_any(text, STEP_MARKERS), 0.1).otherwise(0.0)
        + F.when(aspects >= 4, 0.1).when(aspects >= 2, 0.05).otherwise(0.0)
    )
    return F.least(F.lit(0.95), total)

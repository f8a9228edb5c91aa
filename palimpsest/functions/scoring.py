"""Rules that score and classify texts, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import LATIN, RulePack
from . import text as T

#: Characters on either side of a match that may excuse it.
REACH = 25
#: Either edge of a word. Letters with accents are letters, which ``\b`` does not hold for in every engine.
BORDER = r"(^|[^\p{L}\p{N}_]|$)"

# Patterns of the guard, its excuses, and the classifiers of answers, for the bundled tables and for Korean.
GUARD_LATIN = {"forbid": rf"{BORDER}(idiot|clown|scum|pathetic|worthless){BORDER}", "excuse": r"(['\"].{0,20}['\"]|no longer|used to|the word|not )"}
GUARD_KOREAN = {
    "affection": "(자기야|여보|내 사랑|사랑해|보고싶어 죽겠)", "polite": "(습니다|해요|세요|입니다|드릴게요)", "roster": "(엄마|아빠|친구|민지|선배|점원|의사)",
    "excuse": "(['\"‘’“”].{0,20}['\"‘’“”]|예전엔|옛날엔|그땐|~?라고 불렀|안 할게|안 해|이제 아니|더는|않을게|라는 (단어|말)|이런 (말투|말)|같은 말)",
}
COLD_START_KOREAN = {"past": r"(했잖아|말했잖아|기억나지|알잖아|그때|저번에|지난번|늘\s|맨날|항상)", "admit": r"(모르|기억.{0,3}안|처음\s?듣|들은\s?적\s?없|말한\s?적\s?없|아직)", "ask": r"[?？]|물어|알려\s?줘|뭐야|누구|어떤"}
COLD_START_LATIN = {"past": r"(was|were|hier|ayer|gestern)", "admit": r"(not|nicht|pas|nunca)", "ask": r"[?]|(what|who|qué|quoi|was)"}


# Number words with their counters, endings and small words that the typed scorer looks past.
NUMBERS_KOREAN = (("(하나|한\\s*[명개번회]|1\\s*[명개번회])", "①"), ("(둘|두\\s*[명개번회]|2\\s*[명개번회])", "②"), ("(셋|세\\s*[명개번회]|3\\s*[명개번회])", "③"), ("(넷|네\\s*[명개번회]|4\\s*[명개번회])", "④"))
NUMBERS_LATIN = ((r"\b(one|eins|uno|1)\b", "①"), (r"\b(two|zwei|dos|2)\b", "②"), (r"\b(three|drei|tres|3)\b", "③"))
TAIL_KOREAN, TAIL_LATIN = "(하|해|한|히|잖|스럽|롭)+$", "(e|a|o)+$"
SMALL_KOREAN, SMALL_LATIN = ("안", "은", "는", "이", "가"), ("th", "of", "d")
#: Questions whose answers only a person can judge.
BY_HAND = ("abstention", "coverage")

# What a state forbids, as (name, field, value, pattern), and who may not enter a closed scene.
STATE_RULES_KOREAN = (("stage=헤어짐", "stage", "헤어짐", GUARD_KOREAN["affection"]), ("stage=낯섦", "stage", "낯섦", GUARD_KOREAN["affection"]), ("speech=반말", "speech", "반말", GUARD_KOREAN["polite"]))
STATE_RULES_LATIN = (("stage=apart", "stage", "apart", rf"{BORDER}(idiot|clown){BORDER}"), ("stage=strange", "stage", "strange", rf"{BORDER}(idiot|clown){BORDER}"), ("speech=casual", "speech", "casual", rf"{BORDER}(scum|pathetic|worthless){BORDER}"))
ROSTER_LATIN = rf"{BORDER}(licensed|casino|copyright){BORDER}"
ROSTER_RULE = "scene=roster"


def violations(text: Column, state: dict[str, Column], rules: tuple, roster: str, excuse: str | None = None) -> Column:
    """The names of the rules that a text breaks in its state, an array; ``state`` has the fields of the rules and ``locked``, a flag.

    With ``excuse`` a match does not count if an excuse stands near it, or, for the roster of a closed scene, anywhere."""
    names = [F.when((state[field] == value) & violates(text, forbid, excuse), name) for name, field, value, forbid in rules]
    outside = state["locked"] & text.rlike(roster)
    names.append(F.when(outside if excuse is None else outside & ~text.rlike(excuse), ROSTER_RULE))
    return F.filter(F.array(*names), lambda n: n.isNotNull())


def canonical(text: Column, pack: RulePack, numbers: tuple, tail: str) -> Column:
    """The words of a text as roots: number words unified, marks and endings gone."""
    for pattern, sign in numbers:
        text = F.regexp_replace(text, pattern, sign)
    root = lambda w: T.let(T.stem(T.bare(w), pack), lambda s: F.when(F.length(s) > 1, F.regexp_replace(s, tail, "")).otherwise(s))
    return F.transform(T.raw_words(text), root)


def typed_verdict(kind: Column, gold: Column, answer: Column, pack: RulePack = LATIN, numbers: tuple = NUMBERS_LATIN, tail: str = TAIL_LATIN, small: tuple = SMALL_LATIN) -> Column:
    """True if one of the gold's alternatives, set apart by ``/``, stands in the answer in one piece or word by word, false if no word of any does.

    Null is left to a person: parts of an alternative, questions without gold, and kinds where not knowing is the right answer."""

    def judge(whole: Column) -> Column:
        def share(alternative: Column) -> Column:
            def of(words: Column) -> Column:
                content = F.filter(words, lambda w: (w != "") & ~w.isin(*small))
                hits = F.size(F.filter(content, lambda w: whole.contains(w)))
                one = F.array_join(words, "")
                return F.when((one != "") & whole.contains(one), 1.0).when(F.size(content) > 0, hits / F.size(content)).otherwise(0.0)

            return T.let(canonical(alternative, pack, numbers, tail), of)

        best = F.array_max(F.transform(F.filter(F.split(gold, r"\s*/\s*"), lambda a: F.trim(a) != ""), share))
        return F.when(best == 1, True).when(best > 0, F.lit(None).cast("boolean")).otherwise(False)

    by_hand = kind.isin(*BY_HAND) | gold.isNull() | (F.trim(gold) == "")
    return F.when(by_hand, F.lit(None).cast("boolean")).otherwise(T.let(F.array_join(canonical(answer, pack, numbers, tail), ""), judge))


def violates(text: Column, forbid: str, excuse: str | None = None) -> Column:
    """Whether a text has a forbidden match; with ``excuse``, whether the first match has no excuse within REACH characters."""
    hit = text.rlike(forbid)
    if excuse is None:
        return hit
    at = F.regexp_instr(text, F.lit(forbid))
    end = at + F.length(F.regexp_substr(text, F.lit(forbid))) - 1
    start = F.greatest(F.lit(1), at - REACH)
    near = F.substring(text, start, end + REACH - start + 1)
    return hit & ~near.rlike(excuse)


def cold_start(text: Column, rules: dict[str, str]) -> dict[str, Column]:
    """Claims a past and does not admit to not knowing; admits; asks back."""
    return {"claims": text.rlike(rules["past"]) & ~text.rlike(rules["admit"]), "admits": text.rlike(rules["admit"]), "asks": text.rlike(rules["ask"])}


# Polite endings of sentences, talk of a family, and signs of a question; for Korean and for the bundled tables.
HONORIFIC_KOREAN = r"(요|습니다|습니까|세요|십시오|이에요|예요|네요|겠어요)[.!?…\s\"']*$"
FAMILY_KOREAN = {"topic": r"(가족|동생|부모|엄마|아빠|형|누나|언니|오빠|집안|집에\s*(무슨|뭔)\s*일)", "ask": r"([?？]|어때|어떠|괜찮|무슨 일|있냐|하냐|했냐)"}
HONORIFIC_LATIN = r"(tion|ly|ing)[.!?…\s]*$"
FAMILY_LATIN = {"topic": rf"{BORDER}(her|his|our|they|and){BORDER}", "ask": r"([?]|what|which|que)"}


def polite(text: Column, ending: str) -> Column:
    """Whether any sentence of a text, of two characters or more, ends politely."""
    sentences = F.transform(F.split(text, r"[.!?…\n]"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.exists(F.filter(sentences, lambda s: F.length(s) >= 2), lambda s: s.rlike(ending))


def probes(text: Column, rules: dict[str, str]) -> Column:
    """Whether a text asks about a topic: it names it and has a sign of a question."""
    return text.rlike(rules["topic"]) & text.rlike(rules["ask"])


def stems(text: Column, pack: RulePack = LATIN) -> Column:
    return F.filter(F.transform(T.raw_words(text), lambda w: T.stem(T.bare(w), pack)), lambda w: w != "")


def verdict(gold: Column, answer: Column) -> Column:
    """True if the gold stems stand in the answer in one piece or one by one, null (for a person) if some do, false if none; arguments are arrays of stems."""
    whole = F.array_join(answer, "")
    share = F.size(F.filter(gold, lambda w: whole.contains(w))) / F.greatest(F.size(gold), F.lit(1))
    return F.when(whole.contains(F.array_join(gold, "")) | (share == 1), True).when(share > 0, F.lit(None).cast("boolean")).otherwise(False)


def confusion(predicted: Column, truth: Column) -> list[Column]:
    """tp, fp, fn, tn, precision and recall."""
    tp, fp, fn = F.count_if(predicted & truth), F.count_if(predicted & ~truth), F.count_if(~predicted & truth)
    ratio = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.count_if(~predicted & ~truth).alias("tn"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall")]

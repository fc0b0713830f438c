"""Deterministic classifiers of questions, answers and pages, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Themes of questions with their patterns. Fixed values.
TOPICS = {
    "pricing": [r"\b(pric|cost|fee|rate|budget|quote|discount|tarif|how much|payment terms?|invoic|billing)\b", r"\b(per (?:seat|user|month|year)|licen[cs]e cost)\b"],
    "implementation": [r"\b(implement|onboard|rollout|roll[- ]out|deploy|migrat|setup|set up|go[- ]live|integration|timeline|how long|lead time|delivery date|deadline|schedule)\b"],
    "security": [r"\b(security|secure|encrypt|gdpr|iso ?27001|soc ?2|compliance|data protection|privacy|breach|penetration test|vulnerab|access control|hosting location|data residency)\b"],
    "contract": [r"\b(contract|agreement|terms?|clause|termination|notice period|renew|liability|indemnit|warrant|sla|penalt|exit|cancel|obligation|governing law|jurisdiction)\b"],
    "financials": [r"\b(revenue|arr|mrr|ebitda|margin|forecast|projection|cash ?flow|burn|runway|valuation|p&l|profit|loss|balance sheet|financial model|assumption)\b"],
    "product": [r"\b(feature|function|capabilit|roadmap|support(?:s|ed)?|does it|can it|api|integrat|limitation|scope|module|workflow)\b"],
    "team": [r"\b(team|founder|headcount|employee|hiring|organi[sz]ation|who is|experience|background|reference|customer)\b"],
    "support": [r"\b(support|help ?desk|response time|availability|uptime|maintenance|training|documentation|account manager)\b"],
}

#: Shapes of requests for whole texts: intent, weight, pattern. Fixed values.
EXTRACTION_RULES = [
    ("bulk_reproduction", 0.95, r"\b(give|show|send|provide|output|print|paste|write|reproduce|transcribe|dump|export|copy|recreate|reconstruct|retype|render)\b[^.?!]{0,60}\b(entire|whole|complete|full|all(?:\s+of)?(?:\s+the)?|every)\b[^.?!]{0,40}\b(document|documents|pdf|file|files|text|contract|report|deck|book|content|pages?|chapters?|sections?)\b"),
    ("verbatim_transcription", 0.8, r"\b(word[-\s]?for[-\s]?word|verbatim|character[-\s]?by[-\s]?character|line[-\s]?by[-\s]?line|exact(?:ly)?\s+as\s+(?:it\s+)?(?:is\s+)?written|in\s+full,?\s+verbatim|raw\s+text|full\s+transcript(?:ion)?)\b"),
    ("page_range_dump", 0.55, r"\b(pages?|slides?|sheets?|chapters?|sections?)\s*\d{1,4}\s*(?:-|–|—|to|through|until|thru)\s*\d{1,4}\b"),
    ("page_range_dump", 0.85, r"\b(give|show|output|print|write|transcribe|reproduce|list|paste|dump)\b[^.?!]{0,30}\b(each|every|all)\s+(pages?|slides?|sheets?|paragraphs?|lines?|sentences?|clauses?)\b"),
    ("sequential_continuation", 0.5, r"^\s*(continue|keep going|go on|next|more|and then\??|carry on)\b[^.?!]{0,40}$|\b(continue|resume|carry on)\b[^.?!]{0,30}\b(from|with|where)\b[^.?!]{0,30}\b(page|slide|paragraph|section|you\s+(?:left|stopped))\b|\b(next|following)\s+(page|slide|section|chapter|paragraph|part)\b"),
]
#: Signs of a question about the content. Fixed value.
COMPREHENSION = r"\b(explain|summar(?:ise|ize)|what\s+(?:is|are|does)|why|how\s+(?:does|do|is)|compare|difference|which\s+section|where\s+is|does\s+the|is\s+there|when\s+(?:is|does)|who\s+(?:is|are)|risk|deadline|obligation|means?)\b"
#: Block score, quoted units and attempts that limit a session, by mode; OFF limits nothing. Fixed values.
MODES = {"STANDARD": (0.75, 60, 8), "STRICT": (0.5, 25, 4), "OFF": (float("inf"), 1 << 30, 1 << 30)}

#: How answers say that they have none. Fixed values.
REFUSALS = [
    r"couldn'?t find", r"could not find", r"not (?:contained|included|present|mentioned|covered) in", r"(?:does|do) not (?:contain|include|mention|cover|specify)",
    r"no information (?:about|on|regarding)", r"isn'?t (?:in|covered)", r"can'?t reproduce",
]
#: Shape of a word or a number. Fixed value.
WELL_FORMED = r"^[\p{L}][\p{L}'’-]*[\p{L}.,;:!?)]?$|^\d+([.,]\d+)*[%]?$"


#: Words that name no theme. Fixed values.
GENERIC = """about after again also any anything are because been before being between both can could did does doing done
each explain find from give has have here how into its just know like make many more most much need not now only other
our out over please said same say see should show some such tell than that the their them then there these they this
those through time under use used using very want was way were what when where which while who why will with would you
your document documents file files page pages""".split()
#: An edge between what counts as a word and what does not where only ASCII letters, digits and _ are words.
_EDGE = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def _any_case(pattern: str) -> str:
    """The pattern for Java, whose own word edge counts letters beyond ASCII too."""
    return "(?i)" + pattern.replace(r"\b", _EDGE)


def topic(question: Column) -> Column:
    """(slug, confidence) of the theme most of whose patterns match; earlier themes win ties.

    Without any it is named by the first two words of four letters or more that are not generic, else 'general'.
    """
    flat = F.trim(question)
    hits = F.array(
        *(
            F.struct(sum((flat.rlike(_any_case(p)).cast("int") for p in patterns), F.lit(0)).alias("hits"), F.lit(-place).alias("place"), F.lit(slug).alias("slug"))
            for place, (slug, patterns) in enumerate(TOPICS.items())
        )
    )
    best = F.array_max(hits)
    found = best["hits"] > 0
    share = F.least(F.lit(0.55) + 0.2 * best["hits"], F.lit(0.95))
    words = F.slice(F.filter(F.split(F.lower(flat), r"[^\p{L}\p{N}-]+"), lambda w: (F.length(w) > 3) & ~w.isin(*GENERIC)), 1, 2)
    derived = F.when(F.size(words) > 0, F.substring(F.array_join(words, "-"), 1, 60)).otherwise("general")
    return F.struct(F.when(found, best["slug"]).otherwise(derived).alias("slug"), F.round(F.when(found, share).otherwise(0.3), 6).alias("confidence"))


def classify_request(question: Column, mode: str = "STANDARD", attempts: Column | None = None, quoted_units: Column | None = None) -> Column:
    """(intent, score, blocked) of a request for reproduction, given what its session did before."""
    limit, most_units, most_attempts = MODES[mode]
    attempts = F.lit(0) if attempts is None else attempts
    quoted_units = F.lit(0) if quoted_units is None else quoted_units
    flat = F.regexp_replace(F.trim(question), r"\s+", " ")
    rules = [F.when(flat.rlike(_any_case(p)), F.struct(F.lit(w).alias("weight"), F.lit(-k).alias("place"), F.lit(i).alias("intent"))) for k, (i, w, p) in enumerate(EXTRACTION_RULES)]
    best = F.array_max(F.array(*rules))
    eased = F.when(flat.rlike(_any_case(COMPREHENSION)) & (best["intent"] != "bulk_reproduction"), 0.25).otherwise(0.0)
    raised = F.least(attempts * 0.12, F.lit(0.4)) + F.when(quoted_units >= most_units, 0.3).otherwise(0.0)
    score = F.when(best.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(best["weight"] - eased + raised, F.lit(1.0))))
    blocked = best.isNotNull() & ((score >= limit) | (attempts >= most_attempts))
    return F.struct(F.coalesce(best["intent"], F.lit("none")).alias("intent"), F.round(score, 3).alias("score"), blocked.alias("blocked"))


def is_refusal(answer: Column) -> Column:
    return reduce(lambda a, b: a | b, (answer.rlike(_any_case(p)) for p in REFUSALS))


def legibility(text: Column, ink_ratio: Column | None = None) -> Column:
    """How likely a page's text is language: score with the ratios it is made of."""
    ink = F.lit(0.0) if ink_ratio is None else F.coalesce(ink_ratio, F.lit(0.0))
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    chars = F.length(flat)
    words = F.filter(F.split(flat, " "), lambda w: F.length(w) > 0)
    count = F.size(words)
    share = lambda top, bottom: F.when(bottom > 0, top / bottom).otherwise(0.0)
    alnum = share(F.regexp_count(flat, F.lit(r"[\p{L}\p{N}]")), chars)
    formed = share(F.size(F.filter(words, lambda w: w.rlike(WELL_FORMED))), count)
    mean = share(F.aggregate(words, F.lit(0), lambda s, w: s + F.length(w)), count)
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    empty = F.when(chars == 0, ink > 0.01).otherwise((ink > 0.03) & (chars < 40))
    raw = clamp(0.5 * formed + 0.3 * alnum + 0.2 * clamp((mean - 1.5) / 3.5))
    score = F.when(chars == 0, 0.0).when(empty, F.least(raw, F.lit(0.2))).otherwise(F.round(raw, 3))
    return F.struct(score.alias("score"), chars.alias("chars"), count.alias("words"), F.round(alnum, 3).alias("alnum"), F.round(formed, 3).alias("well_formed"), F.round(mean, 2).alias("mean_length"), empty.alias("empty_read"))


def needs_vision(text: Column, least: int = 40) -> Column:
    seen = legibility(text)
    return (seen["chars"] < least) | (seen["alnum"] < 0.45) | (seen["well_formed"] < 0.55)

"""Clause cues: how often a text speaks in each dimension. Overlapping matches of one dimension count once, which needs their spans: an Arrow UDF."""

from __future__ import annotations

import re
from functools import lru_cache, reduce
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from loomgraph.functions import algebra as A

#: The cues of each dimension, matched without regard to case.
CUES = {
    "causal": [
        r"\bif\b", r"\bwhere\b", r"\bbecause\b", r"\bunless\b", r"\bresulting in\b", r"\bresult(?:s|ed|ing)?\s+(?:in|from)\b", r"\benables?\b", r"\bprovided that\b", r"\bin the event (?:of|that)\b",
        r"\bowing to\b", r"\bas a result of\b", r"\bgiven that\b", r"\bdue to\b", r"\bcause[sd]?\b", r"\btrigger(?:s|ed|ing)?\b", r"\blead(?:s|ing)?\s+to\b", r"\bgive\s+rise\s+to\b", r"\brisk[s]?\b",
        r"\blikely\s+to\b", r"\bprevent(?:s|ed|ing)?\b", r"\baffect(?:s|ed|ing)?\b",
    ],
    "intentional": [
        r"\bfor the purposes? of\b", r"\bin order to\b", r"\baimed at\b", r"\bwith (?:a )?view to\b", r"\bintended to\b", r"\bso as to\b", r"\bto (?:ensure|protect|enable|facilitate|safeguard|guarantee)\b",
        r"\bnecessary for\b", r"\bobjective[s]?\b", r"\bseek(?:s|ing)?\s+to\b", r"\bin order that\b", r"\bpurpose[s]?\s+of\b",
    ],
    "temporal": [
        r"\bwithin\s+\d+\s*(?:hour|day|week|month|year)s?\b", r"\bwithin\s+(?:one|two|three|four|five|six|seven|eight|nine|ten)\s+(?:hour|day|week|month|year)s?\b",
        r"\bwithin\s+(?:a|the)\s+(?:period|time\s+limit|deadline)\b", r"\bwithout undue delay\b", r"\bbefore\b", r"\bafter\b", r"\bprior to\b", r"\bno later than\b", r"\bat the latest\b",
        r"\bas soon as possible\b", r"\bonce\b", r"\bfollowing\b", r"\bduring\b", r"\bperiod[s]?\b", r"\bdeadline[s]?\b", r"\bsubsequently\b", r"\bat the time of\b", r"\bby\s+\d\b",
    ],
    "structural": [
        r"\bpart of\b", r"\bconsists? of\b", r"\bconsisting of\b", r"\bmeans\s+(?:any|a|an|the)\b", "[‘'][^‘’']{1,40}[’'][^’']{0,30}means\\b", r"\breferred to in paragraph\b", r"\breferred\s+to\s+in\b",
        r"\bcomprise[sd]?\b", r"\bcomprising\b", r"\bis composed of\b", r"\bcomposed of\b", r"\binclude[sd]?\b", r"\bcategor(?:y|ies|ised|ized)\b", r"\bdefinition[s]?\b", r"\bpursuant to\b",
        r"\bin accordance with\b", r"\bChapter\s+[IVXLCDM]+\b", r"\bparagraph\s+\d+\b", r"\bAnnex\b", r"\bset out in\b",
    ],
    "relational": [
        r"\bcontroller[s]?\b", r"\bprocessor[s]?\b", r"\bdata\s+subject[s]?\b", r"\bthird\s+part(?:y|ies)\b", r"\bsupervisory\s+authorit(?:y|ies)\b", r"\bjoint\s+controller[s]?\b", r"\brepresentative[s]?\b",
        r"\brecipient[s]?\b", r"\bnatural\s+person[s]?\b", r"\bright\s+to\b", r"\bobligation[s]?\b", r"\bbetween\b",
    ],
}




@lru_cache(1024)
def needle(pattern: str) -> str:
    """The longest stretch of letters that every match of a pattern holds, in lower case."""
    best = now = ""
    for op, value in [*re._parser.parse(pattern), (None, None)]:
        now = now + chr(value) if op is re._constants.LITERAL else ""
        best = max(best, now, key=len)
    return best.lower()


NEEDLES = {d: [needle(p) for p in found] for d, found in CUES.items()}
#: Letters that match i or s where case counts for nothing, and that lower() leaves apart.
_FOLD = {0x130: "i", 0x131: "i", 0x17F: "s"}
COMPILED = {d: [re.compile(p, re.IGNORECASE) for p in found] for d, found in CUES.items()}


def folded(text: str) -> str:
    """A text in lower case, in which a needle stands wherever its pattern matches."""
    return text.lower() if text.isascii() else text.translate(_FOLD).lower()


def runs(text: str, patterns: list[re.Pattern]) -> int:
    """Separate stretches of text that the matches of all patterns cover together: those spans that begin where no earlier one still reaches."""
    spans = sorted(m.span() for p in patterns for m in p.finditer(text))
    reach = [-1, *accumulate((end for _, end in spans), max)]
    return sum(start >= r for (start, _), r in zip(spans, reach, strict=False))


def counts(text: str) -> dict[str, int]:
    """The cues of each dimension. A pattern is tried only where its letters stand in the text."""
    low = folded(text)
    return {d: runs(text, tried) if (tried := [p for p, n in zip(found, NEEDLES[d], strict=True) if n in low]) else 0 for d, found in COMPILED.items()}


@F.pandas_udf(StructType([StructField(d, LongType()) for d in A.DIMENSIONS]))
def cue_hits(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([counts(t) for t in texts.fillna("")], columns=A.DIMENSIONS)


def cue_counts(texts: DataFrame, text: str) -> DataFrame:
    """The columns of texts, and a count for each dimension. A null text has none."""
    return texts.withColumn("hits", cue_hits(F.col(text))).select("*", "hits.*").drop("hits")


def contributions(citations: Column | None = None, scale: float = 1.0) -> list[Column]:
    """Of counts: citations add to the structural one, and the relational one gives way to the other four."""
    structural = F.col("structural") + (citations if citations is not None else F.lit(0))
    others = reduce(lambda a, b: a + b, (structural, *(F.col(d) for d in ("causal", "intentional", "temporal"))))
    relational = A.relational_effective(F.col("relational").cast("double"), others.cast("double"), scale)
    return [structural.cast("double").alias("structural"), *(F.col(d).cast("double").alias(d) for d in ("causal", "intentional", "temporal")), relational.alias("relational")]

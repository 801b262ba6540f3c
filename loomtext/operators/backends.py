"""Pluggable models behind Arrow batches: classifier, detector and annotator, with deterministic offline defaults."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.schemas import TOKEN, WINDOW
from .topics import ASK, TOPICS, messages, parse_response


class Classifier(Protocol):
    """Answers a batch of chats, each a list of (role, content)."""

    def generate(self, chats: list[list[tuple[str, str]]]) -> list[str]: ...


class Detector(Protocol):
    def detect(self, text: str) -> dict: ...


class Annotator(Protocol):
    def annotate(self, texts: list[str]) -> list[list[list[dict]] | None]: ...


class KeywordClassifier:
    """Answers with the id of the topic whose words the text holds most often."""

    def __init__(self):
        self.words = [set(re.findall(r"[a-z]{4,}", f"{t} {d}".lower())) for t, d in TOPICS.items()]

    def generate(self, chats: list[list[tuple[str, str]]]) -> list[str]:
        out = []
        for chat in chats:
            own = set(re.findall(r"[a-z]{4,}", chat[-1][1].removeprefix(ASK).lower()))
            scores = [len(own & w) for w in self.words]
            out.append(str(scores.index(max(scores))) if max(scores) else "")
        return out


class RuleDetector:
    """Shares from the density of dashes and long words: a stand-in with the real result's shape."""

    def detect(self, text: str) -> dict:
        words = text.split() or [""]
        score = min(1.0, sum(len(w) > 12 for w in words) / len(words) * 5 + text.count("—") / len(words) * 10)
        return {
            "fraction_ai": 1.0 if score > 0.9 else 0.0, "fraction_ai_assisted": round(score, 4), "fraction_human": round(1 - score, 4),
            "num_ai_segments": int(score > 0.9), "windows": [{"label": "rule", "ai_assistance_score": round(score, 4), "confidence": "low"}],
        }


class RuleAnnotator:
    """Sentences at end marks, words as their own lemmas, closed-class tags from short lists, a flat tree."""

    #: Closed-class words.
    CLOSED = {
        "DET": "de het een", "PRON": "ik jij hij zij wij ze we je u", "CCONJ": "en of maar want", "ADP": "in op van voor met aan uit door naar",
        "AUX": "is was zijn waren heeft had hebben wordt werd worden kan kon zal zou", "ADV": "niet ook nog al wel er nu toen",
    }

    def __init__(self):
        self.tags = {w: t for t, ws in self.CLOSED.items() for w in ws.split()}

    def annotate(self, texts: list[str]) -> list[list[list[dict]] | None]:
        return [self._one(t) if t and t.strip() else None for t in texts]

    def _one(self, text: str) -> list[list[dict]]:
        out = []
        for s in re.split(r"(?<=[.!?])\s+", text.strip()):
            words = re.findall(r"\w+|[^\w\s]", s)
            tags = ["PUNCT" if not w[0].isalnum() else self.tags.get(w.lower(), "NUM" if w.isdigit() else "NOUN") for w in words]
            root = next((i for i, t in enumerate(tags) if t != "PUNCT"), 0)
            out.append([
                {"id": i + 1, "text": w, "lemma": w.lower(), "upos": t, "feats": "VerbForm=Fin" if t == "AUX" else None, "deprel": "root" if i == root else "dep", "head": 0 if i == root else root + 1}
                for i, (w, t) in enumerate(zip(words, tags))
            ])
        return out


_RESULT = f"struct<fraction_ai:double,fraction_ai_assisted:double,fraction_human:double,num_ai_segments:int,windows:array<{WINDOW}>,error:string>"


def classify(df: DataFrame, text: str = "full_text", make: Callable[[], Classifier] = KeywordClassifier, batch: int = 8) -> DataFrame:
    """df with predicted_topic for rows that have none (resume): chats and parsing are columns, only the model is Python.
    It gets ``batch`` chats at a time, and only those of rows without a topic."""

    @F.pandas_udf("string")
    def answer(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in parts:
            asked = [i for i, chat in enumerate(s) if chat is not None]
            out = pd.Series([None] * len(s), dtype=object)
            for a in range(0, len(asked), batch):
                part = asked[a : a + batch]
                for i, r in zip(part, model.generate([[(m["role"], m["content"]) for m in s.iat[i]] for i in part])):
                    out.iat[i] = r
            yield out

    old = F.col("predicted_topic") if "predicted_topic" in df.columns else F.lit(None).cast("string")
    return df.withColumn("predicted_topic", F.coalesce(old, parse_response(answer(F.when(old.isNull(), messages(text))))))


def detect(df: DataFrame, text: str = "full_text", make: Callable[[], Detector] = RuleDetector) -> DataFrame:
    """df with a detector result per non-empty text; failures are recorded in error, null fractions stay null."""

    @F.pandas_udf(_RESULT)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make()
        for s in parts:
            rows = []
            for t in s:
                row = dict.fromkeys(("fraction_ai", "fraction_ai_assisted", "fraction_human", "num_ai_segments", "windows", "error"))
                try:
                    row |= model.detect(t)
                except Exception as e:  # a model's failure is a result here
                    row["error"] = str(e)
                rows.append(row)
            yield pd.DataFrame(rows)

    clean = df.withColumn("__t", F.trim(F.coalesce(text, F.lit("")))).where("__t != ''")
    return clean.withColumn("__r", run("__t")).select(*df.columns, F.length("__t").alias("text_length"), "__r.*")


def annotate(df: DataFrame, text: str, make: Callable[[], Annotator] = RuleAnnotator, batch: int = 32) -> DataFrame:
    """df with parsed_sentences; null for empty texts."""

    @F.pandas_udf(f"array<array<{TOKEN}>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in parts:
            texts = [t if isinstance(t, str) else "" for t in s]
            yield pd.Series([r for a in range(0, len(texts), batch) for r in model.annotate(texts[a : a + batch])], dtype=object)

    return df.withColumn("parsed_sentences", run(text))

"""Batch next-word prediction for a table of phrases.

phrase -> lower, split on spaces -> last two words -> ids (0 when unknown)
-> distinct contexts -> pruned candidates -> stupid or Katz scores -> top k
per context (ties kept unless ``ties='first'``) -> joined back to phrases.
Phrases sharing a context are scored once.  All columns of the phrase table
but ``phrase`` are its key and come back with every prediction; what was
asked and cannot be answered is listed by ``predict_status``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions.text import clean_text, format_percent, phrase_words, round_half_up
from glossa.operators.candidates import prediction_candidates
from glossa.operators.scoring import candidate_scores
from glossa.operators.topk import top_k
from glossa.session import materialise
from glossa.sources.wordlists import profanity_words, stop_ids, stop_word_list

ALGOS = ("stupid", "katz")
TOO_SHORT = "too_short"


def phrase_keys(phrases: DataFrame) -> list[str]:
    return [c for c in phrases.columns if c != "phrase"]


def parse_phrases(phrases: DataFrame, clean: bool = False, remove_words=None) -> DataFrame:
    """Key columns, w1, w2, n_words, valid: the last two words of each phrase.
    A phrase of fewer than two words is flagged ``valid = false``."""
    text = F.col("phrase")
    if clean:
        text = clean_text(text, profanity_words() if remove_words is None else remove_words)
    arr = phrase_words(text)
    keys = phrase_keys(phrases)
    p = phrases.select(*keys, F.coalesce(arr, F.array().cast("array<string>")).alias("_w"))
    n = F.size("_w")
    return p.select(
        *keys,
        F.when(n >= 2, F.element_at("_w", -2)).alias("w1"),
        F.when(n >= 2, F.element_at("_w", -1)).alias("w2"),
        n.alias("n_words"),
        (n >= 2).alias("valid"))


def predict_status(model, phrases: DataFrame, clean: bool = False) -> DataFrame:
    """Key columns, n_words, status, n_known: one row per phrase.  ``status`` is
    ``ok`` or ``too_short`` (no prediction is made); ``n_known`` says how many
    of the last two words are in the vocabulary."""
    parsed = parse_phrases(phrases, clean)
    known = lambda c: F.when(F.col(c) > 0, 1).otherwise(0)
    enc = encode_contexts(model, parsed)
    return enc.select(*phrase_keys(phrases), "n_words", F.when(F.col("valid"), "ok").otherwise(TOO_SHORT).alias("status"),
                      (known("u") + known("v")).alias("n_known"))


def encode_contexts(model, parsed: DataFrame) -> DataFrame:
    """Add u, v ids (0 for a word outside the vocabulary)."""
    bc = model.broadcast_ok
    v1 = model.vocab.select(F.col("word").alias("w1"), F.col("idx").alias("u"))
    v2 = model.vocab.select(F.col("word").alias("w2"), F.col("idx").alias("v"))
    return (parsed.join(F.broadcast(v1) if bc else v1, "w1", "left")
            .join(F.broadcast(v2) if bc else v2, "w2", "left")
            .withColumn("u", F.coalesce("u", F.lit(0)))
            .withColumn("v", F.coalesce("v", F.lit(0))))


def context_predictions(model, contexts: DataFrame, algo: str = "stupid", k: int = 10,
                        stop_idx: DataFrame | None = None, stop_key=None, d: float = 0.5,
                        a: float = 0.4, ties: str = "all", rank_col: str | None = None) -> DataFrame:
    """(u, v, w, prob[, rank]) -- the top k words of each distinct context."""
    if algo not in ALGOS:
        raise ValueError(f"algo must be one of {ALGOS}")
    if not isinstance(k, int) or k < 1:
        raise ValueError("k must be a positive integer")
    cand = prediction_candidates(model, contexts, k, stop_idx, stop_key)
    return top_k(candidate_scores(model, cand, algo, d, a), ["u", "v"], "prob", k, ["w"], ties, rank_col)


def resolve_stop_ids(model, include_stop_words: bool, stop_words=None):
    """(ids, key) of the stop words to leave out; both None when none are.
    The tables that depend on them are kept by the model under the key."""
    if include_stop_words:
        return None, None
    if stop_words is None:
        raise ValueError("leaving stop words out needs a list: pass stop_words")
    key = tuple(stop_word_list(model.vocab.sparkSession, stop_words))
    return model._memo(("stop", key), lambda: materialise(stop_ids(model.vocab, key), "stop-ids")), key


def predict(model, phrases: DataFrame, algo: str = "stupid", k: int = 10,
            include_stop_words: bool = True, stop_words=None, d: float = 0.5, a: float = 0.4,
            ties: str = "all", clean: bool = False, rank_col: str | None = None) -> DataFrame:
    """Key columns, word_idx, word, prob[, rank] for every phrase of two words
    or more (``predict_status`` names the others)."""
    keys = phrase_keys(phrases)
    enc = encode_contexts(model, parse_phrases(phrases, clean).filter("valid"))
    stop_idx, key = resolve_stop_ids(model, include_stop_words, stop_words)
    top = context_predictions(model, enc.select("u", "v"), algo, k, stop_idx, key, d, a, ties, rank_col)
    words = model.vocab.select(F.col("idx").alias("w"), "word")
    return (enc.select(*keys, "u", "v").join(top, ["u", "v"])
            .join(F.broadcast(words) if model.broadcast_ok else words, "w")
            .select(*keys, F.col("w").alias("word_idx"), "word", "prob", *([rank_col] if rank_col else [])))


def predict_one(model, phrase: str, clean: bool = False, **kw) -> DataFrame:
    """Single phrase, best word first; a phrase that has fewer than two words
    (after cleaning, if asked for) is an error."""
    spark = model.vocab.sparkSession
    df = spark.createDataFrame([(phrase,)], "phrase string")
    if not parse_phrases(df, clean).first()["valid"]:
        raise ValueError("prediction needs a phrase of two or more words")
    return predict(model, df, clean=clean, **kw).orderBy(F.col("prob").desc(), "word_idx")


def format_predictions(pred: DataFrame, digits: int | None = 8) -> DataFrame:
    """Key columns, Word, Probability with the probability printed as a
    percent.  The probability is first rounded to ``digits`` places (the
    precision predictions are reported at)."""
    p = round_half_up("prob", digits) if digits is not None else F.col("prob")
    keys = [c for c in pred.columns if c not in ("word_idx", "word", "prob")]
    return pred.select(*keys, F.col("word").alias("Word"), format_percent(p).alias("Probability"))

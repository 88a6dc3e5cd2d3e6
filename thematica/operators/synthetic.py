"""Synthetic-data request preparation and response unpacking (X15, T17, T18,
A35).  The model call itself is out of scope; everything around it is a
DataFrame job: selection, labels, split, prompt text, token/cost estimate,
and turning generated responses back into labelled rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markers as M
from ..functions import text as T
from ..functions.lexicon import Lexicon
from . import dedupe as D
from . import filters as FL
from .training import stratified_split

# FIXED VALUES: prompt template, label descriptions, copies per record, price.
MULTIPLIER = 10
PRICE_PER_MILLION = 0.15
SEPARATOR = "<sep>"
PROMPT_FORMAT = (
    "Below is a record from a database of development and humanitarian assistance. I need your help to "
    "create synthetic data to train a classifier network. Could you please write {} synthetic records based "
    "on the example, separated by new lines, that mirrors it in length, content, vocabulary, language, and "
    "theme? Separate each record with <sep>. The synthetic records should reflect the theme we are trying to "
    "classify, which is '{}'. {}. Please only write the synthetic records and no additional text.")
SEMANTIC_LABELS = {
    "Significant": ("Significant disability objective",
                    "Significant means that addressing disability is an important and deliberate objective, "
                    "but not the principal reason for undertaking the project/programme, often explained as "
                    "disability being mainstreamed in the project/programme"),
    "Principal": ("Principal disability objective",
                  "Principal means that addressing disability is the main objective of the project/programme "
                  "and is fundamental is its design and expected results. The project/programme would not "
                  "have been undertaken without this objective"),
}


def select_examples(df: DataFrame, sig: str, lex: Lexicon, text: str = "text", order_col: str | None = None,
                    seed=42, test: float = 0.8) -> DataFrame:
    """X15 selection: declared 1/2, usable, lexicon match on the cleaned text,
    dedupe on text, Significant/Principal label, stratified split."""
    x = df.where(FL.declared(None, sig, (1, 2))).where(FL.usable_text(text))
    x = x.where(lex.match(T.clean_text(F.col(text))))
    x = D.dedupe(x.select(text, sig, *([order_col] if order_col else [])), [text], order_col)
    x = x.withColumn("label", M.case_assign([(F.col(sig) == 1, "Significant")], default="Principal"))
    return stratified_split(x.select(text, "label"), "label", test, seed, (text,))


def prepare_prompts(examples: DataFrame, multiplier: int = MULTIPLIER) -> DataFrame:
    """The system prompt of each training example."""
    sem = F.create_map(*[F.lit(x) for k, (a, b) in SEMANTIC_LABELS.items() for x in (k, a)])
    extra = F.create_map(*[F.lit(x) for k, (a, b) in SEMANTIC_LABELS.items() for x in (k, b)])
    fmt = PROMPT_FORMAT.replace("%", "%%").replace("{}", "%s")
    return examples.withColumn("system_prompt", F.format_string(
        fmt, F.lit(str(multiplier)), sem[F.col("label")], extra[F.col("label")]))


def estimate_cost(prompts: DataFrame, multiplier: int = MULTIPLIER, price: float = PRICE_PER_MILLION,
                  text: str = "text", tokens=None) -> DataFrame:
    """Token volume (prompts + text x (multiplier+1)) and price.

    ``tokens`` maps a text Column to a token-count Column; default is the
    whitespace word count (a BPE tokenizer can be plugged in as a pandas UDF).
    """
    count = tokens or (lambda c: F.size(F.filter(F.split(F.trim(c), r"\s+"), lambda t: t != "")))
    tok = F.sum(count(F.col("system_prompt")) + F.lit(multiplier + 1) * count(F.col(text)))
    return prompts.agg(tok.cast("long").alias("tokens")).withColumn(
        "cost", F.round(F.col("tokens") / F.lit(1e6) * F.lit(price), 4))


def unpack_responses(responses: DataFrame, response: str = "response", label: str = "label",
                     sep: str = SEPARATOR) -> DataFrame:
    """Split generated text on the separator, trim, drop empty pieces,
    one labelled row each."""
    import re

    x = responses.select(F.col(label), F.explode(F.split(F.col(response), re.escape(sep))).alias("text"))
    return x.select(F.trim(F.col("text")).alias("text"), label).where(F.col("text") != "")

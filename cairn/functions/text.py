"""Normalisation, tokens, stop words and stems as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stop words, Portuguese then English, and suffix rules (suffix, least length, replacement).
STOPWORDS = (
    "a as o os um uma uns umas de da do das dos em no na nos nas por pelo pela pelos pelas para pra pro pros com sem sob sobre entre até após "
    "que qual quais quem cujo cuja é foi era são está estão ser ter tem não sim se ou mas como quando onde isso isto aquilo esse este aquele "
    "ele ela eles elas seu sua seus suas meu minha teu tua nosso nossa há já lá aí ali aqui agora depois antes muito pouco mais menos também ainda "
    "fazer faz fez fazendo feito dizer disse diz dizendo dito ir vai indo pode podem devem deve "
    "the an is are was were be been being have has had having does did doing will would shall should may might must can could "
    "i you he she it we they me him her us them my your his its our their this that these those in on at to for of with from by about "
    "and or not but if so than then also very just now here there some any all each every yes other more only"
).split()
PLURAL = (("ns", 4, "m"), ("oes", 3, "ao"), ("aes", 3, "ao"), ("ais", 4, "al"), ("eis", 4, "el"), ("is", 5, "il"), ("res", 5, "r"), ("s", 3, ""))
FEMININE = (("issima", 6, ""), ("ona", 5, "ao"), ("ora", 4, "or"), ("inha", 5, "inho"), ("esa", 5, "es"), ("a", 3, ""))
ADVERB = (("mente", 7, ""),)
SIZE = (("issimo", 6, ""), ("inho", 5, ""), ("inha", 5, ""), ("zao", 4, ""), ("zona", 5, ""))
NOUN = (
    ("acional", 8, ""), ("icoes", 6, "icao"), ("ancia", 6, ""), ("encia", 6, ""), ("izacao", 7, ""), ("al", 4, ""), ("idade", 6, ""), ("mento", 6, ""), ("eza", 4, ""),
    ("ice", 4, ""), ("dor", 4, ""), ("tor", 4, ""), ("cao", 4, ""), ("oes", 4, "ao"), ("ar", 4, ""), ("er", 4, ""), ("ir", 4, ""),
)
VERB = (
    ("assemos", 6, ""), ("essemos", 6, ""), ("issemos", 6, ""), ("assedes", 7, ""), ("asseis", 7, ""), ("aramos", 6, ""), ("eramos", 6, ""), ("iramos", 6, ""),
    ("areis", 6, ""), ("ereis", 6, ""), ("ireis", 6, ""), ("astes", 6, ""), ("estes", 6, ""), ("istes", 6, ""), ("asse", 5, ""), ("esse", 5, ""), ("isse", 5, ""),
    ("aram", 5, ""), ("eram", 5, ""), ("iram", 5, ""), ("avas", 5, ""), ("aveis", 6, ""), ("ando", 5, ""), ("endo", 5, ""), ("indo", 5, ""), ("ado", 4, ""), ("ido", 4, ""),
    ("ara", 4, ""), ("era", 4, ""), ("ira", 4, ""), ("ava", 4, ""), ("iam", 4, ""), ("am", 3, ""), ("em", 3, ""), ("ou", 3, ""), ("iu", 3, ""), ("as", 3, ""), ("es", 3, ""), ("is", 3, ""),
    ("a", 2, ""), ("e", 2, ""), ("i", 2, ""),
)
VOWEL = (("e", 4, ""), ("a", 4, ""), ("o", 4, ""))
STEPS = (PLURAL, FEMININE, ADVERB, SIZE, NOUN, NOUN, NOUN, NOUN, NOUN, VERB, VOWEL)
ENDS = [tuple(r[0] for r in step) for step in STEPS]
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def normalize(text: Column) -> Column:
    """Lower case, trimmed, Latin accents off. Letters that are no Latin base with an accent stay as they are."""
    return F.translate(F.lower(F.trim(text)), MARKED, PLAIN)


def tokens(text: Column, stop: bool = False) -> Column:
    all_ = F.regexp_extract_all(normalize(text), F.lit("[a-z0-9]{2,}"), F.lit(0))
    return F.filter(all_, lambda t: ~t.isin(STOPWORDS)) if stop else all_


def stem(word: Column) -> Column:
    """Stem by ordered suffix rules: in each step the first rule that fits and leaves three letters wins.

    One fold over a literal array of rules, so the expression stays small; the rules
    carry the number of their step, and a step is over when one of them has fitted.
    """
    rules = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(n).alias("n"), F.lit(r).alias("r"), F.lit(k).alias("k")) for k, step in enumerate(STEPS) for s, n, r in step])

    def apply(a: Column, r: Column) -> Column:
        out = F.concat(F.substring(a["w"], F.lit(1), F.length(a["w"]) - F.length(r["s"])), r["r"])
        fits = (a["k"] != r["k"]) & (F.length(a["w"]) >= r["n"]) & F.endswith(a["w"], r["s"]) & (F.length(out) >= 3)
        return F.when(fits, F.struct(out.alias("w"), r["k"].alias("k"))).otherwise(a)

    start = F.struct(word.alias("w"), F.lit(-1).alias("k"))
    return F.when(F.length(word) <= 2, word).otherwise(F.aggregate(rules, start, apply, lambda a: a["w"]))


def stem_sql(table: str, word: str = "t") -> str:
    """CTEs ``v0`` .. for SQL engines: distinct words of ``table`` with their stems, the last named ``stems(t, s)``."""
    out = [f"v0 AS (SELECT DISTINCT {word} AS t, {word} AS s FROM {table})"]
    for k, step in enumerate(STEPS):
        cases = " ".join(f"WHEN length(s) >= {n} AND suffix(s, '{x}') AND length(s) - {len(x)} + {len(r)} >= 3 THEN left(s, length(s) - {len(x)}) || '{r}'" for x, n, r in step)
        out.append(f"v{k + 1} AS (SELECT t, CASE WHEN length(t) <= 2 THEN s {cases} ELSE s END AS s FROM v{k})")
    return ", ".join(out) + f", stems AS (SELECT t, s FROM v{len(STEPS)})"


def stem_word(word: str) -> str:
    """``stem`` of one word."""
    if len(word) <= 2:
        return word
    for step, ends in zip(STEPS, ENDS):
        if word.endswith(ends):
            for suffix, least, put in step:
                if len(word) >= least and word.endswith(suffix) and len(word) - len(suffix) + len(put) >= 3:
                    word = word[: len(word) - len(suffix)] + put
                    break
    return word


def stems(words: DataFrame, column: str) -> DataFrame:
    """``words`` with a column ``stem``: each distinct word is stemmed once, in Arrow batches, and joined back.

    The fold of ``stem`` is interpreted rule by rule; over a whole vocabulary plain Python is several times faster.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if w is None else stem_word(w) for w in b.column(0).to_pylist()], pa.string())], names=[column, "stem"])

    known = words.select(column).distinct().mapInArrow(run, f"`{column}` string, stem string")
    return words.join(known, column)

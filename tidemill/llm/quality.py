"""Quality rules as weak supervision, with DataFrame functions alone.

Seven rules on a document's words and lines each vote good (1), bad (-1) or abstain (0). No two of them count the same
characters, words or lines: symbols, words of one to three letters, repeated windows, distinct words, repeated lines, lines, lengths. So
where two of them agree, it is because of what the document is, and how far a rule can be trusted shows in how often others agree.
The numbers of documents by vote pattern (3^7 rows at most, whatever the input) go to the driver, where
expectation-maximisation estimates for each rule how often it votes good on good documents and bad on bad
ones. A document's quality is the posterior probability of good given its votes; that replaces the demand
that all rules pass: one bad vote of a rule that often votes so alone doesn't condemn a document. The fixed
base conditions stand before it.

Defined cases: a null or empty text has no words and fails the base; very long texts are looked through whole; repeated rows each
get their own equal result; an empty table gives an empty result; columns other than the text don't matter and are kept as they are.
Three-word windows are found by 64-bit hashes within one document and compared by their words.
"""

from dataclasses import dataclass
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import stored

#: White space between words, as a pattern and as its characters.
SPACE, BLANKS = r"[\x20\x09-\x0D]+", "\x20\x09\x0a\x0b\x0c\x0d"
#: A word of one to three letters and nothing else; of such words prose has many, and lists and junk few.
SHORT = r"(?<![^\x20\x09-\x0D])\p{L}{1,3}(?![^\x20\x09-\x0D])"
#: Prefix of the columns that hold what the rules look at.
P = "_q_"


def _without(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def with_features(docs: DataFrame, column: str = "text") -> DataFrame:
    """For the texts in a column adds _q_n_words, _q_word_chars, _q_n_symbols, _q_n_dup_lines, _q_n_repeat_words, _q_n_lines, _q_n_distinct and _q_n_short."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    c = lambda name: F.col(P + name)
    df = docs.withColumns({
        P + "words": F.when(F.btrim(text, F.lit(BLANKS)) == "", F.array().cast("array<string>")).otherwise(F.split(F.btrim(text, F.lit(BLANKS)), SPACE)),
        P + "lines": F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""),
        P + "n_symbols": _without(text, r"[#*$%&|<>]+").cast("long"),
        P + "n_short": F.regexp_count(text, F.lit(SHORT)),
    })
    n = F.size(c("words"))
    df = df.withColumns({
        P + "n_words": n.cast("long"),
        P + "word_chars": F.length(F.array_join(c("words"), "")).cast("long"),
        P + "n_lines": F.size(c("lines")),
        P + "n_distinct": F.size(F.array_distinct(c("words"))),
        P + "n_dup_lines": (F.size(c("lines")) - F.size(F.array_distinct(c("lines")))).cast("long"),
        P + "grams": F.transform(F.slice(c("words"), F.lit(1), F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(c("words"), i + 1), F.get(c("words"), i + 2))),
    }).drop(P + "lines")
    # Only documents with a repeated hash go on to sort, 32 bits of it above a place's 31: equal neighbours are compared by their words.
    keys = F.transform(c("grams"), lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 32), 31).bitwiseOR(i.cast("long")))
    df = df.withColumn(P + "placed", F.when(F.size(F.array_distinct(c("grams"))) < F.size(c("grams")), F.sort_array(keys))).drop(P + "grams")
    high, place = lambda x: F.shiftright(x, 31), lambda x: x.bitwiseAND(2**31 - 1).cast("int")
    near = F.filter(c("placed"), lambda x, k: (high(x) == high(F.get(c("placed"), k - 1))) | (high(x) == high(F.get(c("placed"), k + 1))))
    word = lambda x, k: F.get(c("words"), place(x) + k)
    told = lambda x: F.struct(F.struct(high(x).alias("h"), word(x, 0).alias("a"), word(x, 1).alias("b"), word(x, 2).alias("c")).alias("w"), place(x).alias("i"))
    df = df.withColumn(P + "told", F.array_sort(F.transform(near, told))).drop(P + "placed", P + "words")
    same = F.filter(c("told"), lambda x, k: (x["w"] == F.get(c("told"), k - 1)["w"]) | (x["w"] == F.get(c("told"), k + 1)["w"]))
    df = df.withColumn(P + "at", F.sort_array(F.transform(same, lambda x: x["i"]))).drop(P + "told")
    steps = F.transform(c("at"), lambda x, k: F.least(F.lit(3), F.coalesce(F.get(c("at"), k + 1) - x, F.lit(3))))
    return df.withColumn(P + "n_repeat_words", F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop(P + "at")


def base_failed() -> Column:
    return (F.col(P + "n_words") < 50) | (100 * F.col(P + "n_repeat_words") > 50 * F.col(P + "n_words"))


def _vote(share: Column, good: float, bad: float) -> Column:
    """Good up to a share, bad from another on, between them (or with no share at all) nothing."""
    return F.when(share <= good, 1).when(share >= bad, -1).otherwise(0)


def votes() -> dict[str, Column]:
    """The rules by name. All go by shares of the document, so length by itself decides nothing."""
    c = lambda name: F.col(P + name)
    words, chars = F.nullif(c("n_words"), F.lit(0)), F.nullif(c("word_chars"), F.lit(0))
    return {
        "word_length": F.when((chars / words).between(3, 10), 1).when((chars / words < 2.5) | (chars / words > 12), -1).otherwise(0),
        "symbols": _vote(c("n_symbols") / words, 0.02, 0.1),
        "short_words": _vote(1 - c("n_short") / words, 0.85, 0.92),
        "repeated_words": _vote(c("n_repeat_words") / words, 0.1, 0.2),
        "few_words": _vote(1 - c("n_distinct") / words, 0.5, 0.7),
        "repeated_lines": _vote(c("n_dup_lines") / F.nullif(c("n_lines"), F.lit(0)), 0.1, 0.3),
        "short_lines": _vote(c("n_lines") / words, 0.1, 0.25),
    }


#: How many rules there are.
RULES = 7


def vote_pattern() -> Column:
    """All votes as one number in base 3."""
    out = F.lit(0)
    for v in votes().values():
        out = out * 3 + v + 1
    return out


@dataclass(frozen=True)
class Model:
    """prior: share of good documents. good, bad: by rule, how often its vote is right on good and on bad ones."""

    prior: float
    good: tuple[float, ...]
    bad: tuple[float, ...]

    def posterior(self, pattern: int) -> float:
        odds = log(self.prior / (1 - self.prior))
        for g, b in zip(reversed(self.good), reversed(self.bad), strict=True):
            pattern, v = divmod(pattern, 3)
            odds += log(g / (1 - b)) if v == 2 else log((1 - g) / b) if v == 0 else 0.0
        return 1 / (1 + exp(-max(-500.0, min(500.0, odds))))


#: Where the estimate starts, and the made-up documents that stand behind it (few: they keep shares off 0 and 1).
START, MADE_UP = Model(0.9, (0.95,) * RULES, (0.4,) * RULES), 2.0


def fit(counts: dict[int, int], rules: int = RULES, rounds: int = 100, start: Model | None = None) -> Model:
    """Expectation-maximisation over the numbers of documents by vote pattern.

    No share is held within bounds. ``MADE_UP`` documents with the shares of the start are added to what is counted
    for each; those that abstain say nothing about a rule. If in the end the class called good is the one that has more
    bad votes, the names are exchanged.
    """
    model = start or Model(START.prior, START.good[:1] * rules, START.bad[:1] * rules)
    first = model
    voted = {p: [p // 3 ** (rules - 1 - j) % 3 for j in range(rules)] for p in counts}
    total = sum(counts.values())
    for _ in range(rounds if total else 0):
        q = {p: model.posterior(p) for p in counts}
        kept = sum(n * q[p] for p, n in counts.items())
        good, bad = [], []
        for j in range(rules):
            cell = {(1, 2): MADE_UP * first.good[j], (1, 0): MADE_UP * (1 - first.good[j]), (0, 0): MADE_UP * first.bad[j], (0, 2): MADE_UP * (1 - first.bad[j])}
            for p, n in counts.items():
                if (v := voted[p][j]) != 1:
                    cell[1, v] += n * q[p]
                    cell[0, v] += n * (1 - q[p])
            good.append(cell[1, 2] / (cell[1, 2] + cell[1, 0]))
            bad.append(cell[0, 0] / (cell[0, 2] + cell[0, 0]))
        model = Model((kept + MADE_UP * first.prior) / (total + MADE_UP), tuple(good), tuple(bad))
    if sum(model.good) + sum(model.bad) < rules:
        model = Model(1 - model.prior, tuple(1 - b for b in model.bad), tuple(1 - g for g in model.good))
    return model


def pattern_counts(featured: DataFrame) -> dict[int, int]:
    """Documents that pass the base by vote pattern: at most 3^7 rows, a bound that doesn't depend on the input."""
    return {r["p"]: r["n"] for r in featured.filter(~base_failed()).groupBy(vote_pattern().alias("p")).agg(F.count("*").alias("n")).collect()}


def posterior(model: Model) -> Column:
    """Probability of good by the votes, as an expression of literals."""
    odds = F.lit(log(model.prior / (1 - model.prior)))
    for v, g, b in zip(votes().values(), model.good, model.bad, strict=True):
        odds = odds + F.when(v == 1, log(g / (1 - b))).when(v == -1, log((1 - g) / b)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def keep_good(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose base holds and whose posterior quality is at least so much; columns as they were.

    The features are computed once and stored with the documents, whose own columns, of whatever names, lie
    in a struct meanwhile.
    """
    featured = stored(with_features(docs.select(F.struct("*").alias("row")), "row.text"), "quality-rows")
    model = fit(pattern_counts(featured))
    return featured.filter(~base_failed() & (posterior(model) >= least)).select("row.*")

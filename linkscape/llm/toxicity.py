"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult, threat, target, negation, reporting verb, quotation mark, clause and sentence ends, anything else.
Four small transducers read the symbols: one tells insults at somebody from bare ones, one finds threats at somebody, one finds what is
negated before it is said, one what is only reported.  They are composed into one machine (its states are what all four know) that
says at the end of each clause which kind of match it was, so that clauses are scored, not words.

Weights are learned.  Words, or beginnings of words, that stand in toxic texts far more often than chance allows join the
lexicon, each with its log odds; a listed word starts with LISTED observations.  Occurrences are counted by the words around them, so a thousand copies of one text
count once.  The weight of each kind of clause is a logistic regression, pulled towards the grammar's own weights.
"""

from __future__ import annotations

import itertools
import math
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkscape.llm.common import cut, table
from linkscape.llm.language import held_out

# Words of the grammar, in English, German, French and Spanish.
INSULTS = (
    "idiot idiots idiotic moron morons stupid dumb fool fools loser losers trash garbage scum clown clowns pathetic worthless disgusting "
    "imbecile jerk pig creep filth vermin bastard idioten dumm dummkopf trottel versager abschaum widerlich wertlos erbärmlich dreck "
    "idiote crétin imbécile stupide nul ordure minable déchet dégoûtant idiota imbécil estúpido estúpida tonto basura escoria asqueroso patético inútil"
).split()
THREATS = "kill hurt beat destroy stab shoot strangle punish crush burn töten umbringen schlagen vernichten tuer tuerai frapper détruire matar mataré golpear destruir".split()
TARGETS = "you your yours yourself thou thee u he she they him her them du dich dir ihr euch sie er tu toi te vous il elle ils elles tú usted ustedes vosotros él ella ellos ellas".split()
NEGATIONS = "not no never none without isn't aren't wasn't don't doesn't nicht kein keine keinen nie niemals pas jamais aucun ni nunca jamás sin".split()
REPORTING = "said says say called calls wrote writes told tells asked claimed reported quoted sagte sagt nannte schrieb dit disait appelle écrit dijo dice llamó escribió".split()

#: Observations that a listed word starts with: toxic, other.
LISTED = (5.0, 1.0)
#: Labelled rows to learn from, drawn by a hash of ``doc_id``; all, if there are fewer.
SAMPLE = 20_000
#: Learned entries: letters of a beginning, most entries, least share of occurrences in toxic texts (lower bound at two deviations).
SHORTEST, LONGEST, MOST_UNITS, LEAST_SHARE = 3, 8, 2_000, 0.4
#: Occurrences from which a longer beginning, or a whole word, is known apart from a shorter one, and the least weight of an insult.
KNOWN, LEAST_WEIGHT = 10, 1.0
#: Letters of a word that are looked at.
WORD_LETTERS = 32
KINDS = ("bare", "aimed", "threat")
MANNERS = ("plain", "negated", "reported")
CLASSES = [(k, m) for k in KINDS for m in MANNERS]
#: What the regression is pulled to: a weight for each kind, what is left of it for each manner, and for no match.
PRIOR, LEFT, BIAS, PULL = {"bare": 1.0, "aimed": 1.5, "threat": 1.5}, {"plain": 1.0, "negated": 0.3, "reported": 0.3}, -3.0, 1.0
PREDICTED = 0.3

SYMBOLS = "IHYNRQ,.O"
TOKEN = re.compile(r"([^\W\d_]+(?:['’][^\W\d_]+)?)|([.!?;\n])|([,:])|([\"“”„«»])")
WORD = re.compile(r"[^\W\d_]+")


class Transducer:
    """A deterministic machine: ``step[state, symbol]`` is the next state, ``says[state, symbol]`` what it says then, if anything."""

    def __init__(self, start, step: dict, says: dict):
        self.start, self.step, self.says = start, step, says

    @staticmethod
    def of(start, move, say) -> "Transducer":
        """From functions of (state, symbol), over the states reached from ``start``."""
        step, says, todo, known = {}, {}, [start], {start}
        while todo:
            state = todo.pop()
            for symbol in SYMBOLS:
                to = step[state, symbol] = move(state, symbol)
                if (said := say(state, symbol)) is not None:
                    says[state, symbol] = said
                if to not in known:
                    known.add(to)
                    todo.append(to)
        return Transducer(start, step, says)

    def __mul__(self, other: "Transducer") -> "Transducer":
        """The composition: both read the same symbols, a state is a pair, and what both say is joined."""
        return Transducer.of(
            (self.start, other.start),
            lambda s, x: (self.step[s[0], x], other.step[s[1], x]),
            lambda s, x: said if (said := self.says.get((s[0], x), ()) + other.says.get((s[1], x), ())) else None,
        )


def _both(hit: str, kinds: dict[int, str]) -> Transducer:
    """Sees in a clause whether ``hit`` (1) and a target (2) occurred, and says at its end which kind that is."""
    ends = ",."
    return Transducer.of(0, lambda s, x: 0 if x in ends else s | (x == hit) | 2 * (x == "Y"), lambda s, x: (kinds[s],) if x in ends and s in kinds else None)


INSULT = _both("I", {1: "bare", 3: "aimed"})
THREAT = _both("H", {3: "threat"})
#: 0 nothing, 1 negated so far, 2 said plainly, 3 said after a negation.
NEGATION = Transducer.of(0, lambda s, x: 0 if x in ",." else (1 if x == "N" else 2 if x in "IH" else 0) if s == 0 else 3 if s == 1 and x in "IH" else s, lambda s, x: ("negated",) if x in ",." and s == 3 else None)


def _reported(s: tuple[int, int, int], x: str) -> tuple[int, int, int]:
    """(verb of reporting in this sentence, quotation open, match under one of these): a verb holds to the end of the sentence, a quotation to its closing mark."""
    verb, quoted, under = s
    if x == ".":
        return 0, quoted, 0
    if x == ",":
        return verb, quoted, 0
    if x == "Q":
        return verb, 1 - quoted, under
    return (1 if x == "R" else verb), quoted, (1 if x in "IH" and (verb or quoted) else under)


REPORTED = Transducer.of((0, 0, 0), _reported, lambda s, x: ("reported",) if x in ",." and s[2] else None)
GRAMMAR = INSULT * THREAT * NEGATION * REPORTED


def _numbered(machine: Transducer) -> tuple[list[dict[str, int]], list[dict[str, list[int]]]]:
    """The machine with states as numbers from 0, the start; what it says as places in CLASSES."""
    states = [machine.start, *sorted({s for s, _ in machine.step} - {machine.start}, key=str)]
    place = {s: k for k, s in enumerate(states)}

    def classes(said: tuple[str, ...]) -> list[int]:
        manner = "reported" if "reported" in said else "negated" if "negated" in said else "plain"
        return [CLASSES.index((k, manner)) for k in said if k in KINDS]

    return [{x: place[machine.step[s, x]] for x in SYMBOLS} for s in states], [{x: classes(machine.says[s, x]) for x in SYMBOLS if (s, x) in machine.says} for s in states]


STEP, SAYS = _numbered(GRAMMAR)


class Lexicon:
    """Symbols of words. ``units``: beginnings (``abc``) and whole words (``abc$``) with their weight as insults."""

    def __init__(self, units: dict[str, float]):
        self.units = units
        fixed = {"H": THREATS, "Y": TARGETS, "N": NEGATIONS, "R": REPORTING}
        self.memo: dict[str, tuple[str, float]] = {w: (x, 1.0 if x == "H" else 0.0) for x, words in fixed.items() for w in words}
        self.fixed = dict(self.memo)

    def of(self, word: str) -> tuple[str, float]:
        found = self.memo.get(word)
        if found is None:
            weight = next((self.units[u] for u in reversed(units_of(word)) if u in self.units), 0.0)  # the longest that is known
            found = ("I", weight) if weight >= LEAST_WEIGHT else ("O", 0.0)
            if len(self.memo) > 300_000:
                self.memo = dict(self.fixed)
            self.memo[word] = found
        return found

    def features(self, text: str) -> list[float]:
        """For each class of clauses, the log of 1 and the weights of its matches; last, if there is any match, that of the number of words, as chance finds more in a long text."""
        sums = [0.0] * len(CLASSES)
        text, of = text.lower(), self.of
        words = WORD.findall(text)
        if not any(of(w)[0] in "IH" for w in set(words)):
            return [*sums, 0.0]
        state, weight = 0, 0.0
        for word, end, soft, _ in itertools.chain(TOKEN.findall(text), [("", ".", "", "")]):
            if word:
                symbol, w = of(word.replace("’", "'")) if "'" in word or "’" in word else of(word)
                weight += w
            else:
                symbol = "." if end else "," if soft else "Q"
                if symbol != "Q":
                    for k in SAYS[state].get(symbol, ()):
                        sums[k] += weight
                    weight = 0.0
            state = STEP[state][symbol]
        return [*[math.log1p(x) for x in sums], math.log1p(len(words)) if any(sums) else 0.0]


def units_of(word: str) -> list[str]:
    """The beginnings of a word and the whole of it."""
    return [*[word[:k] for k in range(SHORTEST, min(LONGEST, len(word)) + 1)], word[:WORD_LETTERS] + "$"]


def _occurrences(batches):
    """``word, around, toxic`` for each word of ``text, toxic``."""
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = [w[:WORD_LETTERS] for w in WORD.findall((text or "").lower())]
            around = [f"{a} {b}" for a, b in zip(["", *words], [*words[1:], ""], strict=False)][: len(words)]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(around, pa.string()), pa.array([toxic] * len(words), pa.int32())], names=["word", "around", "toxic"])


def learn_lexicon(labelled: DataFrame) -> Lexicon:
    """Listed words and learned units, from ``text, toxic``; at most MOST_UNITS of the latter reach the driver."""
    places = labelled.mapInArrow(_occurrences, "word string, around string, toxic int").groupBy("word", F.xxhash64("word", "around").alias("place")).agg(F.min("toxic").alias("toxic"))
    words = cut(places.groupBy("word").agg(F.sum("toxic").cast("double").alias("t"), F.count("*").cast("double").alias("n")))
    total = words.agg(F.sum("t").alias("t"), F.sum("n").alias("n")).first()
    size = F.length("word")
    beginnings = F.transform(F.when(size >= SHORTEST, F.sequence(F.lit(SHORTEST), F.least(size, F.lit(LONGEST)))).otherwise(F.array().cast("array<int>")), lambda k: F.substring("word", F.lit(1), k))
    units = words.select(F.explode(F.concat(beginnings, F.array(F.concat("word", F.lit("$"))))).alias("unit"), "t", "n").groupBy("unit").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    units = cut(units)
    listed = {f"{w}$" for w in INSULTS}
    share = min(max((total["t"] or 0.0) / max(total["n"] or 0.0, 1.0), 1e-6), 1 - 1e-6)
    if not total["t"]:
        return Lexicon(dict.fromkeys(listed, 3.0))
    t, n = F.col("t"), F.col("n")
    c = n - t
    loglike = t * F.log(t / n / share) + F.when(c > 0, c * F.log(c / n / (1 - share))).otherwise(0.0)
    lower = (t / n + 2 / n - 2 * F.sqrt((t / n * c / n + 1 / n) / n)) / (1 + 4 / n)
    # chance allows one unit in twenty corpora of this size
    sure = units.where("t >= 3").where((loglike > math.log(20 * max(units.count(), 1))) & (lower >= LEAST_SHARE))
    chosen = {r["unit"] for r in sure.orderBy(loglike.desc(), "unit").limit(MOST_UNITS).collect()}
    heads = [F.substring("unit", 1, k).isin([u for u in chosen if len(u) == k]) for k in range(SHORTEST, LONGEST + 1) if any(len(u) == k for u in chosen)]
    below = units.where(reduce(lambda x, y: x | y, heads, F.lit(False))).where(n >= KNOWN).orderBy(F.desc("n"), "unit").limit(MOST_UNITS)  # what begins like them, with its own share
    seen = {r["unit"]: (r["t"], r["n"]) for r in units.where(F.col("unit").isin(sorted(chosen | listed))).unionByName(below).collect()}
    shares: dict[str, tuple[float, float]] = {}  # of toxic and of other texts; what is left of 1 after several beginnings would be rounded away
    for unit in sorted(chosen | listed | seen.keys(), key=lambda u: (len(u), u)):
        above = next((shares[unit[:k]] for k in range(min(len(unit) - 1, LONGEST), SHORTEST - 1, -1) if unit[:k] in shares), (share, 1 - share))
        toxic, n_seen = seen.get(unit, (0.0, 0.0))
        more = LISTED if unit in listed else tuple(x * KNOWN / 2 for x in above)
        whole = n_seen + sum(more)
        shares[unit] = (toxic + more[0]) / whole, (n_seen - toxic + more[1]) / whole
    odds = math.log(share / (1 - share))
    return Lexicon({u: min(max(math.log(x) - math.log(y) - odds, 0.0), 8.0) for u, (x, y) in shares.items()})


def fit_weights(rows: list[tuple[list[float], int]]) -> np.ndarray:
    """Bias and a weight for each class: the logistic regression with a normal prior around the grammar's weights, by Newton steps."""
    prior = np.array([BIAS, *[PRIOR[k] * LEFT[m] for k, m in CLASSES], 0.0])
    if not rows:
        return prior
    x, y = np.array([[1.0, *f] for f, _ in rows]), np.array([float(t) for _, t in rows])
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - PULL * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + PULL * np.eye(len(w)), gradient)
        w = w + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def score(self, text: str) -> float:
        return float(1 / (1 + math.exp(-min(max(self.weights[0] + float(np.dot(self.weights[1:], self.lexicon.features(text))), -30.0), 30.0))))


def _featured(lexicon: Lexicon):
    def run(batches):
        for batch in batches:
            rows = [lexicon.features(x or "") for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column("toxic")], names=["features", "toxic"])

    return run


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Model:
    """From the rows of ``docs`` (``doc_id, text``) that are not held out and that ``labels`` (``doc_id, toxic``) marks 0 or 1; about ``sample`` of them.

    Of several labels of one id the highest holds; null ids, null labels and null texts teach nothing; without a toxic row the grammar's own weights stand.
    """
    marks = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = marks.where(~held_out())
    n = rows.count()
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < min(1.0, sample / max(n, 1)) * 1_000_000)
    own = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
    taught = cut(own.join(drawn, "doc_id").select("text", "toxic"))
    lexicon = learn_lexicon(taught)
    # a few numbers a row, and no more rows than the sample has
    found = taught.mapInArrow(_featured(lexicon), "features array<double>, toxic int").groupBy("features", "toxic").count().collect()
    rows = [(list(r["features"]), r["toxic"]) for r in found for _ in range(r["count"])]
    return Model(lexicon, fit_weights(rows))


def _scored(model: Model):
    def run(batches):
        for batch in batches:
            scores = [model.score(x or "") for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, predicted`` for each row of ``docs``.

    Null texts count as empty, and texts without a match score what no match scores; repeated rows come back each; an empty
    table gives an empty result; columns other than ``doc_id`` and ``text`` are ignored.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(_scored(model), T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType())]))
    return found.withColumn("predicted", (F.col("score") >= PREDICTED).cast("int"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``; learned from labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")

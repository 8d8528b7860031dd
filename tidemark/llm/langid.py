"""Language identification by interpolated Kneser-Ney character models.

Each language gets a character model over words: an event is a letter (or a word's
end) after up to `order - 1` signs of the same word and its start mark. All
languages share sorted arrays of 64-bit n-gram hashes, one pair for each order, with
a column of log-probabilities (and one of back-off weights) for each language.
A text's language has the lowest cross-entropy an event. It is rejected if that entropy
lies above a limit for its length. Limits, and what the score makes of margins between
languages and of high entropies, are calibrated on labelled texts the models did not see, whole
and in pieces of 2 to 256 events: beyond the quantile of 99 %, excesses are taken to fall off
exponentially, and the limit lets one in 10,000 unseen texts (FALSE_REJECTIONS) of
a learned language be rejected at any length.

Only letters count: words are runs of letters, lower-cased. A word's score doesn't
depend on its neighbours, so each distinct word of a batch is scored once.

The fit takes a bounded sample of the labelled rows: about `rows_a_language` rows and
`bytes_a_language` bytes (a share chosen by a hash of the id), and of a long text `words_a_text`
words spread evenly. n-grams are counted where the texts are, and summed by a shuffle. The driver
holds the n-grams of that sample, some 100 bytes for each of its bytes at most.

Defined cases: null texts and texts without a letter have no language (`und`, score
0) and are rejected; without labelled rows every text is `und`; a language of few rows is learned
from all of them; more than `most_languages` languages are an error; ties go to the first language in
alphabetical order; repeated rows are alike; an empty table gives no rows; other
columns pass through (those named like the added ones are replaced).
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, made, map_batches, sampled, share, spans_of_rows, trim
from tidemark.llm.words import mix

UNDETERMINED = "und"
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
START, END = "\x02", "\x03"
_FACTORS = np.random.default_rng(20240609).integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Share of unseen texts of a learned language that may be rejected.
FALSE_REJECTIONS = 1e-4
#: Events of the pieces that limits are calibrated on, beside whole texts.
LENGTHS = (2, 4, 8, 16, 32, 64, 128, 256)
#: Chosen rows from which a language spares a fifth of them for calibration.
SPARED_FROM = 25
#: Signs among which the chance of one never seen is spread: letters of other scripts cost what they are worth.
ALPHABET = 1 << 16
#: Distinct tokens whose scores a task keeps.
KEPT_TOKENS = 100_000


def words_of(token: str) -> list[str]:
    return _LETTERS.findall(token.lower())


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k signs that end at each position; the first k - 1 are of no use."""
    own = mix(codes.astype(np.uint64) + np.uint64(0x51ED270B))
    out = np.zeros(len(codes), np.uint64)
    for j in range(min(k, len(codes))):
        out[j:] += own[: len(codes) - j] * _FACTORS[j]
    return mix(out + np.uint64(k))


def hash_text(grams: list[str]) -> np.ndarray:
    """Hashes of n-grams of equal length."""
    if not grams:
        return np.zeros(0, np.uint64)
    k = len(grams[0])
    codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32)
    return gram_hashes(codes, k)[k - 1 :: k]


@dataclass
class Model:
    languages: list[str]
    order: int
    grams: list[tuple[np.ndarray, np.ndarray]]  # by order from 1: sorted hashes, log-probabilities a language (NaN: not seen)
    contexts: list[tuple[np.ndarray, np.ndarray]]  # by length from 0: sorted hashes, log back-off weights (0: not seen)
    unknown: np.ndarray  # log-probability of a sign never seen
    usual: np.ndarray = field(default_factory=lambda: np.full(len(LENGTHS), np.inf))  # by length: entropy that 99 % of unseen pieces stay under
    excess: np.ndarray = field(default_factory=lambda: np.ones(len(LENGTHS)))  # by length: mean of what goes over it
    sharpness: tuple[float, float] = (1.0, 0.5)  # of the score: factor, and power of the events

    def excesses(self, entropy: np.ndarray, events: np.ndarray) -> np.ndarray:
        """How far entropies lie over the usual, in mean excesses at their length."""
        at = np.log(np.clip(events, LENGTHS[0], LENGTHS[-1]))
        with np.errstate(invalid="ignore"):
            over = (entropy - np.interp(at, np.log(LENGTHS), self.usual)) / np.interp(at, np.log(LENGTHS), self.excess)
        return np.nan_to_num(np.maximum(over, 0), nan=0.0)

    def scores(self, entropy: np.ndarray, events: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and rejection of texts by their entropies in each language."""
        over = self.excesses(entropy.min(1), events)
        return posterior(entropy, events, self.sharpness).max(1) * np.exp(-over), over > np.log(0.01 / FALSE_REJECTIONS)

    def score_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability of each word in each language, and its events."""
        n_languages = len(self.languages)
        if not words:
            return np.zeros((0, n_languages)), np.zeros(0, np.int64)
        codes = np.frombuffer("".join(f"{START}{w}{END}" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 2
        first = np.cumsum(size) - size
        depth = np.arange(len(codes)) - np.repeat(first, size)  # 0 at the start mark
        out = np.full((len(codes), n_languages), np.nan)
        back = np.zeros((len(codes), n_languages))
        for k in range(self.order, 0, -1):
            open_ = np.flatnonzero((depth >= max(1, k - 1)) & np.isnan(out).any(1))
            if not len(open_):
                continue
            found = look(self.grams[k - 1], gram_hashes(codes, k)[open_], np.nan)
            now = np.isnan(out[open_]) & ~np.isnan(found)
            out[open_] = np.where(now, back[open_] + found, out[open_])
            weights = look(self.contexts[k - 1], gram_hashes(codes, k - 1)[open_ - 1] if k > 1 else np.zeros(len(open_), np.uint64), 0.0)
            back[open_] += weights
        out = np.where(np.isnan(out), back + self.unknown, out)
        out[depth == 0] = 0
        return np.add.reduceat(out, first, axis=0), size - 1


def look(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, missing: float) -> np.ndarray:
    hashes, values = table
    if not len(hashes):
        return np.full((len(keys), values.shape[1]), missing)
    at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
    out = values[at].astype(np.float64)
    out[hashes[at] != keys] = missing
    return out


def kneser_ney(counts: dict[str, int], order: int, signs: int) -> tuple[list[dict[str, float]], list[dict[str, float]], float]:
    """Log-probabilities of all n-grams by order and log back-off weights of contexts by length, from the counts
    of maximal n-grams: those of `order` signs, and shorter ones that begin a word. signs: in the alphabet."""
    level: list[dict[str, int]] = [defaultdict(int) for _ in range(order + 1)]
    for gram, n in counts.items():
        level[len(gram)][gram] += n
    for k in range(order, 1, -1):  # kinds of the sign before a gram; grams that begin a word keep their counts
        for gram in level[k]:
            level[k - 1][gram[1:]] += 1
    grams: list[dict[str, float]] = [{} for _ in range(order)]
    contexts: list[dict[str, float]] = [{} for _ in range(order)]
    lower: dict[str, float] = {}
    unknown = np.log(1 / signs)
    for k in range(1, order + 1):
        once = sum(1 for n in level[k].values() if n == 1)
        twice = sum(1 for n in level[k].values() if n == 2)
        discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
        total: dict[str, int] = defaultdict(int)
        kinds: dict[str, int] = defaultdict(int)
        for gram, n in level[k].items():
            total[gram[:-1]] += n
            kinds[gram[:-1]] += 1
        weight = {h: discount * kinds[h] / total[h] for h in total}
        now = {}
        for gram, n in level[k].items():
            h = gram[:-1]
            rest = lower.get(gram[1:], 1 / signs) if k > 1 else 1 / signs
            now[gram] = max(n - discount, 0) / total[h] + weight[h] * rest
        grams[k - 1] = {g: float(np.log(p)) for g, p in now.items()}
        contexts[k - 1] = {h: float(np.log(w)) for h, w in weight.items()}
        lower = now
    return grams, contexts, float(unknown)


def build(counts: dict[str, dict[str, int]], order: int) -> Model:
    """Model from the counts of maximal n-grams of each language."""
    languages = sorted(counts)
    made = [kneser_ney(counts[x], order, ALPHABET) for x in languages]

    def table(parts: list[dict[str, float]], missing: float) -> tuple[np.ndarray, np.ndarray]:
        keys = sorted({g for p in parts for g in p})
        values = np.array([[p.get(g, missing) for p in parts] for g in keys], np.float32).reshape(len(keys), len(parts))
        hashes = hash_text(keys) if keys and keys[0] else np.zeros(len(keys), np.uint64)
        at = np.argsort(hashes, kind="stable")
        return hashes[at], values[at]

    return Model(languages, order, [table([m[0][k] for m in made], np.nan) for k in range(order)], [table([m[1][k] for m in made], 0.0) for k in range(order)], np.array([m[2] for m in made]))


class Scorer:
    """Entropies of texts; keeps the scores of tokens seen before."""

    def __init__(self, model: Model) -> None:
        self.model, self.index = model, {}
        self.scores = np.zeros((0, len(model.languages) + 1))

    def tokens(self, tokens: list[str]) -> np.ndarray:
        """Per token: log-probability in each language, and events."""
        if len(self.index) > KEPT_TOKENS:
            self.index, self.scores = {}, np.zeros((0, len(self.model.languages) + 1))
        new = [t for t in tokens if t not in self.index]
        if new:
            words: dict[str, int] = {}
            owner, which = [], []
            for i, t in enumerate(new):
                for w in words_of(t):
                    owner.append(i)
                    which.append(words.setdefault(w, len(words)))
            spelled = list(words)
            parts = [self.model.score_words(spelled[i : i + 8192]) for i in range(0, max(1, len(spelled)), 8192)]
            value, events = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            rows = np.zeros((len(new), len(self.model.languages) + 1))
            if owner:
                np.add.at(rows, np.array(owner), np.concatenate([value, events[:, None]], 1)[np.array(which)])
            self.index.update(zip(new, range(len(self.scores), len(self.scores) + len(new))))
            self.scores = np.concatenate([self.scores, rows])
        return self.scores[np.fromiter(map(self.index.__getitem__, tokens), np.int64, len(tokens))]

    def entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Per text: cross-entropy an event in each language, and the number of events."""
        offsets = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0)), dtype=np.int64)])
        parts = []
        for a, b in spans_of_rows(offsets):
            lists = pc.utf8_split_whitespace(pc.fill_null(column.slice(a, b - a), "").cast(pa.large_string()))
            coded = lists.flatten().dictionary_encode()
            sums = np.zeros((b - a, len(self.model.languages) + 1))
            if len(coded):
                each = self.tokens(coded.dictionary.to_pylist())[np.asarray(coded.indices)]
                counts = np.asarray(pc.list_value_length(lists))
                full = np.flatnonzero(counts)
                sums[full] = np.add.reduceat(each, (np.cumsum(counts) - counts)[full], axis=0)
            parts.append(sums)
        all_ = np.concatenate(parts) if parts else np.zeros((0, len(self.model.languages) + 1))
        n = all_[:, -1]
        return -all_[:, :-1] / np.maximum(n, 1)[:, None], n


def posterior(entropy: np.ndarray, events: np.ndarray, sharpness: tuple[float, float]) -> np.ndarray:
    x = -(sharpness[0] * np.maximum(events, 1) ** sharpness[1])[:, None] * (entropy - entropy.min(1, keepdims=True))
    p = np.exp(np.maximum(x, -700))
    return p / p.sum(1, keepdims=True)


def calibrate(model: Model, entropy: np.ndarray, events: np.ndarray, truth: np.ndarray) -> None:
    """Set the model's limits and sharpness by unseen pieces: entropies in each language, events and true languages."""
    low = entropy.min(1)
    for i, length in enumerate(LENGTHS):
        last = i == len(LENGTHS) - 1
        own = low[(events >= length) & ((events < 2 * length) | last)]
        if len(own):
            model.usual[i] = np.quantile(own, 0.99)
            beyond = own[own > model.usual[i]] - model.usual[i]
            # few pieces say little about their tail: it is at least as wide as the bulk
            model.excess[i] = max(float(beyond.mean()) if len(beyond) else 0.0, float(own.std()), 0.05)
    seen = np.isfinite(model.usual)
    if seen.any():
        at = np.arange(len(LENGTHS))
        model.usual, model.excess = (np.interp(at, at[seen], x[seen]) for x in (model.usual, model.excess))
        # what is usual at a length is usual at shorter ones
        model.usual = np.maximum.accumulate(model.usual[::-1])[::-1]
        model.excess = np.maximum.accumulate(model.excess[::-1])[::-1]
    grid = [(float(a), b) for b in (0.0, 0.5, 1.0) for a in 2.0 ** np.arange(-4, 9, 0.5)]
    fits = [np.log(np.maximum(posterior(entropy, events, x)[np.arange(len(truth)), truth], 1e-6)).sum() for x in grid]
    model.sharpness = grid[int(np.argmax(fits))]


def count_grams(docs: DataFrame, order: int, text: str, lang: str, words_a_text: int) -> DataFrame:
    """lang, gram, n: maximal n-grams of the words, at most words_a_text of a text."""

    def make():
        def step(batch: pa.RecordBatch):
            sums: Counter[tuple[str, str]] = Counter()
            words: Counter[tuple[str, str]] = Counter()
            for body, name in zip(batch.column(0), batch.column(1).to_pylist()):
                tokens = (body.as_py() or "").split()
                for token, n in Counter(tokens[:: -(-len(tokens) // words_a_text) or 1]).items():
                    for w in words_of(token):
                        words[name, w] += n
            for (name, w), n in words.items():
                w = f"{START}{w}{END}"
                for i in range(2, len(w) + 1):
                    sums[name, w[max(0, i - order) : i]] += n
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.string()), pa.array(list(sums.values()), pa.int64())], ["lang", "gram", "n"])

        return step

    return map_batches(docs.select(text, lang), make, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, order: int = 4, rows_a_language: int = 2000, bytes_a_language: int = 8 << 20, words_a_text: int = 20_000, most_languages: int = 300, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model | None:
    """Model from the rows of docs that have a language; None without any."""
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    grouped = known.groupBy(lang).agg(F.count(F.lit(1)).alias("n"), F.sum(F.least(F.octet_length(text), F.lit(8 * words_a_text))).alias("bytes"))
    sizes = {r[0]: (r["n"], r["bytes"]) for r in grouped.orderBy(F.desc("n"), lang).limit(most_languages + 1).collect()}
    if not sizes:
        return None
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    shares = {name: min(1.0, rows_a_language / n, bytes_a_language / max(1, size)) for name, (n, size) in sizes.items()}
    part = F.element_at(F.create_map(*(F.lit(x) for pair in shares.items() for x in pair)), F.col(lang))
    few = F.col(lang).isin([name for name, (n, _) in sizes.items() if n * shares[name] < SPARED_FROM])
    chosen = known.filter(sampled(key, part, 3)).withColumn("_part", F.when(few, 1).otherwise(F.pmod(F.xxhash64(F.col(key), F.lit(31)), F.lit(5))))
    rows = count_grams(chosen.filter("_part > 0"), order, text, lang, words_a_text).toArrow()
    counts: dict[str, dict[str, int]] = {name: {} for name in sizes}
    for name, gram, n in zip(*(c.to_pylist() for c in rows.columns)):
        counts[name][gram] = n
    model = build({k: v for k, v in counts.items() if v} or counts, order)
    shared = share(docs.sparkSession, model)
    tried = chosen.filter("_part = 0").select(lang, _pieces(shared)(F.col(text)).alias("p")).collect()
    pieces = [(model.languages.index(r[0]), *p) for r in tried if r[0] in model.languages for p in r.p]
    if pieces:
        found = np.array(pieces)
        calibrate(model, found[:, 2:], found[:, 1], found[:, 0].astype(int))
    return model


def _pieces(shared):
    """Arrow function: events and entropies of a text and of up to four of its pieces of each length."""

    @F.arrow_udf("array<array<double>>")
    def of(column: pa.Array) -> pa.Array:
        scorer, out = made(shared, Scorer), []
        for text in column.to_pylist():
            each = scorer.tokens((text or "").split())
            upto = np.concatenate([np.zeros((1, each.shape[1])), np.cumsum(each, axis=0)])
            ends = [(0, len(each))]
            for length in LENGTHS:
                cuts = np.searchsorted(upto[:, -1], np.arange(5) * length)
                ends += [(a, b) for a, b in zip(cuts, cuts[1:]) if b < len(upto)]
            spans = np.array([upto[b] - upto[a] for a, b in ends])
            spans = spans[spans[:, -1] > 0]
            out.append(np.concatenate([spans[:, -1:], -spans[:, :-1] / spans[:, -1:]], axis=1).tolist())
        trim()
        return pa.array(out, pa.list_(pa.list_(pa.float64())))

    return of


ADDED = "struct<lang_pred:string,score:double,entropy:double,rejected:boolean>"


def identify(docs: DataFrame, model: Model | None, text: str = "text", into: str | None = None) -> DataFrame:
    """docs with lang_pred, score (0 to 1), entropy (nats an event, null without letters) and rejected; into: the name of one struct column for them."""
    if model is None:
        found = F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("entropy"), F.lit(True).alias("rejected"))
        return docs.withColumn(into, found) if into else docs.withColumns({k: found[k] for k in ("lang_pred", "score", "entropy", "rejected")})
    shared = share(docs.sparkSession, model)

    @F.arrow_udf(ADDED)
    def of(column: pa.Array) -> pa.Array:
        scorer = made(shared, Scorer)
        model = scorer.model
        entropy, n = scorer.entropies(column)
        trim()
        if not len(n):
            return pa.array([], pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("entropy", pa.float64()), ("rejected", pa.bool_())]))
        none = n == 0
        names = np.array([*model.languages, UNDETERMINED], dtype=object)[np.where(none, len(model.languages), entropy.argmin(1))]
        score, over = model.scores(entropy, n)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.where(none, 0.0, score)), pa.array(entropy.min(1), mask=none), pa.array(none | over)], ["lang_pred", "score", "entropy", "rejected"])

    if into:
        return docs.withColumn(into, of(F.col(text)))
    (found,) = fresh(docs, "found")
    own = docs.withColumn(found, of(F.col(text)))
    return own.withColumns({k: F.col(found)[k] for k in ("lang_pred", "score", "entropy", "rejected")}).drop(found)

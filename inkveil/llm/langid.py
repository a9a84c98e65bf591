"""Language identification with a linear-chain conditional random field.

Words are labelled, not texts: a word's score for each language is the sum of
the weights of its affixes, n-grams and, if the lexicon has it, itself; learned
transitions tie neighbours. Forward-backward gives each word's probabilities in
its context, so that a text which switches languages is told apart word by word;
a text's language is the one with the largest share of its words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkveil.llm.common import col, table

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: Bounds of the sample that the field is fitted on: texts in all, code points of one stretch of a text, and texts that each language may have anyway.
SAMPLE_TEXTS, SAMPLE_STRETCH, SAMPLE_LANGUAGE = 3000, 500, 20
#: Bounds of the model: features, and words of the lexicon among them.
FEATURES, LEXICON = 60_000, 10_000
#: Training: sequences, words of one, sequences of a step, rounds, and how often a sequence goes on in another language.
SEQUENCES, LENGTH, STEP, ROUNDS, SWITCH = 4000, 32, 64, 4, 0.08
#: Sequences for each language at least, if there are many.
SEQUENCES_EACH = 60
#: Words whose scores a task remembers, texts that are labelled together, and words of a block of a long text.
WORDS, TOGETHER, BLOCK = 150_000, 128, 128
#: With more languages, fewer words and texts are held at once, and long texts are not cut, as matrices of blocks would outgrow them.
MANY = 16


def letters(text: str | None) -> list[re.Match]:
    return [m for m in WORD.finditer(text or "") if any(map(str.isalpha, m.group()))]


def _mixed(x: np.ndarray, kind: int) -> np.ndarray:
    x = (x + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of words in lower case: 64-bit codes of their features, and the number of the word of each.

    A word has itself, its affixes up to four letters, and its runs of two and
    three letters with the borders.
    """
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # zeros stand for the borders
    points = np.frombuffer(("\0" + "\0\0".join(words) + "\0").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.array([len(w) for w in words])
    ends = np.cumsum(lengths + 2) - 1
    starts = ends - lengths
    owner = np.repeat(np.arange(len(words)), lengths + 2)
    own = _mixed(_mixed(points, 7) ^ (np.arange(len(points)) - np.repeat(starts, lengths + 2)).astype(np.uint64), 8)
    codes, owners = [_mixed(np.add.reduceat(own, starts - 1), 1)], [np.arange(len(words))]
    by = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0x94D049BB133111EB, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
    for n in range(1, 5):
        some = np.flatnonzero(lengths >= n)
        for kind, at in ((10, starts[some]), (20, ends[some] - n)):
            codes.append(_mixed(sum(points[at + k] * by[k] for k in range(n)), kind + n))
            owners.append(some)
    for n in (2, 3):
        at = np.flatnonzero(owner[n - 1 :] == owner[: len(owner) - n + 1])
        codes.append(_mixed(sum(points[at + k] * by[k] for k in range(n)), 30 + n))
        owners.append(owner[at])
    return np.concatenate(codes), np.concatenate(owners)


@dataclass(frozen=True)
class Field:
    """Languages, the codes of the features in order, and the weights of features, neighbours and first words."""

    languages: tuple[str, ...]
    codes: np.ndarray
    weights: np.ndarray
    moves: np.ndarray
    first: np.ndarray

    def rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the features that the field has, and the number of the word of each."""
        codes, owner = features(words)
        if not len(self.codes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        has = self.codes[at] == codes
        return at[has], owner[has]

    def scores(self, words: list[str]) -> np.ndarray:
        rows, owner = self.rows(words)
        return np.stack([np.bincount(owner, self.weights[rows, c], len(words)) for c in range(len(self.languages))], axis=1)


def _within(given: np.ndarray, starts: np.ndarray, move: np.ndarray, prior: np.ndarray, after: np.ndarray, halves: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Each word's probabilities in sequences that begin at ``starts``, by falling length, with the end as the last one.

    ``prior`` weighs a sequence's first word, ``after`` its last one. ``halves``
    take the forward and the backward messages, each up to a factor.
    """
    lengths, begin = np.diff(starts), starts[:-1]
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # sequences that are longer than t
    ahead = np.empty_like(given)
    now = prior * given[begin]
    for t in range(lengths[0]):
        if t:
            now = (now[: active[t]] @ move) * given[begin[: active[t]] + t]
        now /= now.sum(axis=1, keepdims=True)
        ahead[begin[: active[t]] + t] = now
    if halves:
        halves[0][:] = ahead
    back = after.copy()
    for t in range(lengths[0] - 1, 0, -1):
        live = slice(0, active[t])
        rows = begin[live] + t
        if halves:
            halves[1][rows] = back[live]
        ahead[rows] *= back[live]
        behind = (given[rows] * back[live]) @ move.T
        back[live] = behind / behind.sum(axis=1, keepdims=True)
    if halves:
        halves[1][begin] = back
    ahead[begin] *= back
    return ahead / ahead.sum(axis=1, keepdims=True)


def _products(given: np.ndarray, starts: np.ndarray, move: np.ndarray) -> np.ndarray:
    """For each sequence the product of its words' and moves' matrices, up to a factor."""
    lengths, begin, k = np.diff(starts), starts[:-1], given.shape[1]
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    out = given[begin][:, None, :] * np.eye(k)
    for t in range(1, lengths[0]):
        live = slice(0, active[t])
        now = (out[live].reshape(-1, k) @ move).reshape(-1, k, k) * given[begin[live] + t][:, None, :]
        out[live] = now / now.sum(axis=(1, 2), keepdims=True)
    return out


def forward_backward(scores: np.ndarray, starts: np.ndarray, moves: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each word's probabilities. ``starts`` are the rows at which sequences begin, with the end as the last one; none is empty.

    Long sequences are cut into blocks. What comes before and after a block
    acts on it through one vector each, which the blocks' matrices give exactly.
    """
    return _messages(scores, starts, moves, first, False)[0]


def with_pairs(scores: np.ndarray, starts: np.ndarray, moves: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``forward_backward``, and how often each language is expected to follow each, summed over all neighbours."""
    return _messages(scores, starts, moves, first, True)


def _messages(scores: np.ndarray, starts: np.ndarray, moves: np.ndarray, first: np.ndarray, pairs: bool) -> tuple[np.ndarray, np.ndarray]:
    if len(starts) < 2:
        return np.zeros_like(scores), np.zeros_like(moves)
    block = BLOCK if len(first) <= MANY else int(np.diff(starts).max())
    move, given = np.exp(moves - moves.max()), np.exp(scores - scores.max(axis=1, keepdims=True))
    begin, number = np.exp(first - first.max()), -(-np.diff(starts) // block)
    owner = np.repeat(np.arange(len(number)), number)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
    tops = starts[owner] + place * block
    lengths = np.minimum(starts[owner + 1] - tops, block)
    order = np.argsort(-lengths, kind="stable")
    edges = np.r_[0, np.cumsum(lengths[order])]
    words = np.repeat(tops[order] - edges[:-1], lengths[order]) + np.arange(len(given))
    given = given[words]
    prior, after = np.tile(begin, (len(order), 1)), np.ones((len(order), len(begin)))
    if number.max() > 1:
        at = np.empty(len(order), np.int64)
        at[order] = np.arange(len(order))  # where each block has gone
        products = _products(given, edges, move)
        by_place = np.argsort(place, kind="stable")
        groups = np.split(by_place, np.cumsum(np.bincount(place))[:-1])
        for blocks in groups[1:]:
            now = np.einsum("ni,nij->nj", prior[at[blocks - 1]], products[at[blocks - 1]]) @ move
            prior[at[blocks]] = now / now.sum(axis=1, keepdims=True)
        for blocks in groups[:0:-1]:
            now = np.einsum("nij,nj->ni", products[at[blocks]], after[at[blocks]]) @ move.T
            after[at[blocks - 1]] = now / now.sum(axis=1, keepdims=True)
    out, expected = np.empty_like(given), np.zeros_like(move)
    halves = (np.empty_like(given), np.empty_like(given)) if pairs else None
    out[words] = _within(given, edges, move, prior, after, halves)
    if halves:
        ahead, behind = np.empty_like(given), np.empty_like(given)
        ahead[words], behind[words] = halves[0], halves[1] * given
        right = np.setdiff1d(np.arange(len(given)), starts[:-1])
        left, right = ahead[right - 1], behind[right]
        expected = move * ((left / ((left @ move) * right).sum(axis=1, keepdims=True)).T @ right)
    return out, expected


def fit(texts: Iterable[tuple[str, str]], seed: int = 7) -> Field | None:
    """The field fitted on stretches ``(text, language)``, with a fixed seed; None if there is no word.

    Sequences are put together from stretches of several languages, since only
    where languages meet can transitions be learned.
    """
    by_language: dict[str, list[list[str]]] = {}
    for text, language in sorted(texts):
        if words := [m.group().lower() for m in letters(text)]:
            by_language.setdefault(language, []).append(words)
    if not by_language:
        return None
    languages = tuple(sorted(by_language))
    count = Counter(w for stretches in by_language.values() for words in stretches for w in words)
    lexicon = sorted(count)
    places = {w: i for i, w in enumerate(lexicon)}
    times = np.array([count[w] for w in lexicon])
    codes, owner = features(lexicon)
    whole = codes[: len(lexicon)]
    parts, where = np.unique(codes[len(lexicon) :], return_inverse=True)
    often = np.bincount(where, times[owner[len(lexicon) :]])
    pick = lambda codes, n, most: codes[n > 1][np.lexsort((codes[n > 1], -n[n > 1]))[:most]]
    chosen = np.unique(np.concatenate([pick(whole, times, LEXICON), pick(parts, often, FEATURES - LEXICON)]))
    random = np.random.default_rng(seed)
    k = len(languages)
    weights, moves, first = np.zeros((len(chosen), k)), np.zeros((k, k)), np.zeros(k)
    field = Field(languages, chosen, weights, moves, first)
    squares = [np.full_like(x, 1e-8) for x in (weights, moves, first)]
    flat, owner = field.rows(lexicon)
    order = np.argsort(owner, kind="stable")
    known = np.split(flat[order], np.searchsorted(owner[order], np.arange(1, len(lexicon))))
    drawn: list[tuple[list[str], np.ndarray]] = []
    sequences = max(SEQUENCES, SEQUENCES_EACH * k)
    for _ in range(sequences):
        words, labels = [], []
        now = int(random.integers(k))
        while len(words) < LENGTH:
            stretches = by_language[languages[now]]
            stretch = stretches[int(random.integers(len(stretches)))]
            at, run = int(random.integers(len(stretch))), int(random.geometric(SWITCH))
            part = stretch[at : at + run]
            words += part
            labels += [now] * len(part)
            now = int(random.integers(k))
        drawn.append((words[:LENGTH], np.array(labels[:LENGTH])))
    starts = np.arange(STEP + 1) * LENGTH
    for round_ in range(ROUNDS):
        order = random.permutation(sequences)
        for at in range(0, sequences - STEP + 1, STEP):
            batch = [drawn[i] for i in order[at : at + STEP]]
            lists = [known[places[w]] for words, _ in batch for w in words]
            flat, owner = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            scores = np.stack([np.bincount(owner, weights[flat, c], len(lists)) for c in range(k)], axis=1)
            truth = np.concatenate([labels for _, labels in batch])
            gap, pairs = with_pairs(scores, starts, moves, first)
            seen = np.zeros((k, k))
            labels = truth.reshape(STEP, LENGTH)
            np.add.at(seen, (labels[:, :-1].ravel(), labels[:, 1:].ravel()), 1)
            start_gap = gap[starts[:-1]].sum(axis=0) - np.bincount(labels[:, 0], minlength=k)
            gap[np.arange(len(truth)), truth] -= 1
            rows_gap = np.stack([np.bincount(flat, gap[owner, c], len(chosen)) for c in range(k)], axis=1) / STEP
            for value, slope, square, rate in ((weights, rows_gap, squares[0], 0.3), (moves, (pairs - seen) / STEP, squares[1], 0.1), (first, start_gap / STEP, squares[2], 0.1)):
                slope = slope + 1e-4 * value
                square += slope * slope
                value -= rate * slope / np.sqrt(square)
    return field


class Places(dict):
    """Numbers words as they come; -1 for those without a letter."""

    def __init__(self) -> None:
        super().__init__()
        self.lettered: list[str] = []

    def __missing__(self, word: str) -> int:
        at = -1
        if any(map(str.isalpha, word)):
            at = len(self.lettered)
            self.lettered.append(word.lower())
        self[word] = at
        return at


class Labeller:
    """Labels texts, and remembers the scores of words."""

    def __init__(self, field: Field) -> None:
        self.field = field
        self.forget()

    def forget(self) -> None:
        self.places = Places()
        self.table = np.empty((0, len(self.field.languages)))

    def rows_of(self, texts: list[list[str]]) -> list[np.ndarray]:
        """For each text's words the rows of their scores; -1 if a word has no letter."""
        if len(self.places) * max(MANY, len(self.field.languages)) > WORDS * MANY:
            self.forget()
        place = self.places.__getitem__
        found = [np.fromiter(map(place, words), np.int64, len(words)) for words in texts]
        if new := self.places.lettered[len(self.table) :]:
            self.table = np.concatenate([self.table, self.field.scores(new)])
        return found

    def probabilities(self, texts: list[list[str]]) -> Iterator[tuple[int, np.ndarray]]:
        """Of each text with a word: its number, and the probabilities of its words, letterless ones left out."""
        rows = [x[x >= 0] for x in self.rows_of(texts)]
        numbers = [i for i, x in enumerate(rows) if len(x)]
        if numbers:
            starts = np.r_[0, np.cumsum([len(rows[i]) for i in numbers])]
            found = forward_backward(self.table[np.concatenate([rows[i] for i in numbers])], starts, self.field.moves, self.field.first)
            for i, a, b in zip(numbers, starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                yield i, found[a:b]


def sampled(docs: DataFrame, id_col: str, text_col: str, lang_col: str, texts: int, stretch: int) -> DataFrame:
    """Rows ``(text, lang)`` of each language: an even share of ``texts``, but SAMPLE_LANGUAGE if that is more.

    Texts are drawn by a hash of id and text, equal ones once, a stretch from a
    hashed place of each. Each language that has a text with a letter has one here.
    """
    rows = docs.select(col(text_col).alias("text"), col(lang_col).cast("string").alias("lang"), F.xxhash64(col(id_col), col(text_col), F.lit(3)).alias("h"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("place", F.pmod("h", F.lit(1 << 40)))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("least")).collect()
    if not counts:
        return rows.select("text", "lang").limit(0)
    each = max(SAMPLE_LANGUAGE, texts // len(counts))
    # somewhat more than each, so that hardly any language falls short
    tops = [(r["lang"], max(r["least"], int(min(1.0, (each + 4 * each**0.5) / r["n"]) * (1 << 40)))) for r in counts]
    rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(tops, "lang string, top long")), "lang").where("place <= top")
    start = F.pmod(F.xxhash64("h"), F.greatest(F.char_length("text") - stretch + 1, F.lit(1))).cast("int")
    rows = rows.select(F.substring(F.col("text"), start + 1, F.lit(stretch)).alias("text"), "lang", "place", "h").dropDuplicates(["lang", "h"])
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place", "h"))).where(F.col("rank") <= each).select("text", "lang")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", texts: int = SAMPLE_TEXTS, stretch: int = SAMPLE_STRETCH) -> Field | None:
    """A field fitted on a sample of the labelled rows: every language, by stretches of ``stretch`` code points, ``texts`` of them or SAMPLE_LANGUAGE of each."""
    return fit([(r["text"], r["lang"]) for r in sampled(docs, id_col, text_col, lang_col, texts, stretch).collect()])


def with_language(df: DataFrame, text_col: str, field: Field | None, lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``df`` with each text's language and the share of its words, from 0 to 1, that the field gives to it.

    A null text and one without a letter are ``und`` with 0.0, and so is any
    text if there is no field. Ties go to the language that sorts first. Texts
    are labelled whole and by nothing but themselves; columns of these two names
    are replaced, others are left as they are. The field travels with the tasks;
    its size is bounded by FEATURES rows of a weight for each language.
    """
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("struct<lang:string,score:double>")
    def tell(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        labeller = Labeller(field) if field else None
        together = max(1, TOGETHER * MANY // max(MANY, len(field.languages))) if field else 1
        for batch in batches:
            out = [{"lang": UNKNOWN, "score": 0.0}] * len(batch)
            for low in range(0, len(batch), together) if labeller else ():
                words = [WORD.findall(x) if x else [] for x in batch.slice(low, together).to_pylist()]
                for number, found in labeller.probabilities(words):
                    mean = found.mean(axis=0)
                    best = int(mean.argmax())
                    out[low + number] = {"lang": field.languages[best], "score": float(min(1.0, mean[best]))}
            yield pa.array(out, kind)

    taken = {c.lower() for c in df.columns}
    name = next(f"_told{k}" for k in range(len(taken) + 1) if f"_told{k}" not in taken)
    done = df.withColumn(name, tell(col(text_col)))
    return done.withColumns({lang_col: F.col(f"{name}.lang"), score_col: F.col(f"{name}.score")}).drop(name)


def with_word_languages(df: DataFrame, text_col: str, field: Field, out_col: str = "words") -> DataFrame:
    """``df`` with the array of a text's words ``(start, end, lang, score)`` in code points, for text that switches languages."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("score", pa.float64())]))

    @F.arrow_udf("array<struct<start:int,end:int,lang:string,score:double>>")
    def label(texts: pa.Array) -> pa.Array:
        words = [letters(x) for x in texts.to_pylist()]
        out = [[]] * len(words)
        for number, found in Labeller(field).probabilities([[m.group() for m in x] for x in words]):
            best = found.argmax(axis=1)
            out[number] = [{"start": m.start(), "end": m.end(), "lang": field.languages[b], "score": float(p[b])} for m, b, p in zip(words[number], best, found, strict=True)]
        return pa.array(out, kind)

    return df.withColumn(out_col, label(col(text_col)))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def told(docs: DataFrame) -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred`` and ``score``; learned from the rows of ``docs`` that are not held out."""
    marked = docs.withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    return with_language(marked, "text", train(marked.where("NOT held_out")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents."""
    return told(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")

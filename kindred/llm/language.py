"""Language of texts by a linear-chain conditional random field over their words.

A word's features are its prefixes, suffixes, letter n-grams and itself (the lexicon), hashed to a fixed table of weights; learned
transitions join neighbouring words, so that a code-switched text is labelled word by word. Forward-backward gives each word's
posterior; a text's language has the largest mean. Forward-backward runs over blocks of words whose transfer matrices are multiplied,
so that numpy handles all texts of a batch at once.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches
from .words import LETTERS, LOWER, mixed, text_chunks, words_of

TABLE = 1 << 16
STEP = 32  # words of a block
PORTION = 1 << 14  # words whose posteriors are held at once while fitting; longer texts are held whole
UNKNOWN = "und"
EMPTY = {"langs": [], "weights": np.zeros((TABLE, 0), np.float32), "trans": np.zeros((0, 0))}


def features(data: np.ndarray, start: np.ndarray, stop: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words (bytes data[start:stop], of hash key): their places in the table, and where each word's begin.

    A word w is read as ^w$ in UTF-8, A-Z lower-cased: all its 2-grams and 3-grams (those at the ends are affixes), the 4-grams at both
    ends, and itself.
    """
    size = stop - start + 2
    begin = np.concatenate([[0], np.cumsum(size)])
    total = int(begin[-1])
    word = np.repeat(np.arange(len(start)), size)
    at = np.arange(total) - begin[word]
    b = np.full(total + 3, 0x5E, np.uint64)  # ^
    inner = (at > 0) & (at < size[word] - 1)
    b[:total][inner] = LOWER[data[(start[word] + at - 1)[inner]]]
    b[begin[1:] - 1] = 0x24  # $
    two = b[:-1] << np.uint64(8) | b[1:]
    three = two[:-1] << np.uint64(8) | b[2:]
    four = three[:-1] << np.uint64(8) | b[3:]
    left = size[word] - at
    ends = four[begin[:-1]], four[np.maximum(begin[1:] - 4, begin[:-1])]
    parts = [two[:total][left > 1] | np.uint64(1 << 60), three[:total][left > 2] | np.uint64(2 << 60), ends[0] | np.uint64(3 << 60), ends[1] | np.uint64(4 << 60), key]
    owners = [word[left > 1], word[left > 2], *[np.arange(len(start))] * 3]
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    place = (mixed(np.concatenate(parts)) % np.uint64(TABLE)).astype(np.int64)[order]
    return place, np.searchsorted(owner[order], np.arange(len(start)))


def marginals(emission: np.ndarray, text: np.ndarray, trans: np.ndarray, transitions: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Posteriors of each word [n, k], and, if asked for, expected transitions [k, k].

    emission: scores of each word; text: non-decreasing numbers of the words' texts; trans: transition scores. A text begins in an even mix.
    """
    n, k = emission.shape
    first = np.flatnonzero(np.diff(text, prepend=-1))
    count = np.diff(np.append(first, n))
    blocks = -(-count // STEP)
    base = np.concatenate([[0], np.cumsum(blocks)])
    row = np.repeat(np.arange(len(first)), count)
    t = np.arange(n) - first[row]
    b, s = base[row] + t // STEP, t % STEP
    total = int(base[-1])
    e = np.ones((total, STEP, k))
    e[b, s] = np.exp(emission - emission.max(1, keepdims=True))
    real = np.zeros((total, STEP), bool)
    real[b, s] = True
    step = np.exp(trans - trans.max())
    # transfer matrix of each block
    m = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    for j in range(STEP):
        new = (m @ step) * e[:, j, None, :]
        new /= new.sum((1, 2), keepdims=True)
        m = np.where(real[:, j, None, None], new, m)
    enter, leave = np.full((total, k), 1.0 / k), np.ones((total, k))
    live, i = np.arange(len(first)), 1
    order = np.argsort(-blocks, kind="stable")
    sorted_blocks = -blocks[order]
    for i in range(1, int(blocks.max())):
        live = order[: np.searchsorted(sorted_blocks, -i, "left")]
        at = base[live] + i
        v = np.einsum("bi,bij->bj", enter[at - 1], m[at - 1])
        enter[at] = v / v.sum(1, keepdims=True)
    for i in range(1, int(blocks.max())):
        live = order[: np.searchsorted(sorted_blocks, -i, "left")]
        at = base[live + 1] - 1 - i
        v = np.einsum("bij,bj->bi", m[at + 1], leave[at + 1])
        leave[at] = v / v.sum(1, keepdims=True)
    forward, backward = np.empty((total, STEP, k)), np.empty((total, STEP, k))
    a = enter
    for j in range(STEP):
        new = (a @ step) * e[:, j]
        new /= new.sum(1, keepdims=True)
        a = np.where(real[:, j, None], new, a)
        forward[:, j] = a
    z = leave
    for j in range(STEP - 1, -1, -1):
        backward[:, j] = z
        new = (e[:, j] * z) @ step.T
        new /= new.sum(1, keepdims=True)
        z = np.where(real[:, j, None], new, z)
    f, r = forward[b, s], backward[b, s]
    del forward, backward
    post = f * r
    post /= post.sum(1, keepdims=True)
    if not transitions:
        return post, None
    inner = np.flatnonzero(t > 0)
    right = e[b, s][inner] * r[inner]
    pair_sum = np.einsum("ni,ij,nj->n", f[inner - 1], step, right)
    expected = step * (f[inner - 1].T @ (right / np.maximum(pair_sum, 1e-300)[:, None]))
    return post, expected


def _texts(column: pa.Array, limit: int = 1 << 18):
    for row, end, data, offsets in text_chunks(column, limit):
        yield row, end, data, offsets, *words_of(data, offsets, LETTERS)


def _whole(text: np.ndarray) -> Iterator[slice]:
    """Slices of words of whole texts, of at most PORTION words or of one text."""
    ends, begin = np.append(np.flatnonzero(np.diff(text)) + 1, len(text)), 0
    while begin < len(text):
        i = int(np.searchsorted(ends, begin + PORTION, "right")) - 1
        end = int(ends[i] if i >= 0 and ends[i] > begin else ends[i + 1])
        yield slice(begin, end)
        begin = end


def _give_back() -> None:
    """Returns freed memory to the system, where the C library can: the driver that has fitted a model goes on running."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def fit(sample: pa.Table, rounds: int = 16, rate: float = 0.4, decay: float = 0.01) -> dict:
    """Weights and transitions from texts and their languages; each word of a text is given the text's language. Without any word, none."""
    told, chunks = sample.column("lang").to_pylist(), list(_texts(sample.column("text").combine_chunks(), 1 << 62))
    if not chunks or not len(chunks[0][-1]):
        return dict(EMPTY)
    _, _, data, _, text_no, start, stop, h = chunks.pop()
    langs = sorted({told[i] for i in np.unique(text_no).tolist()})  # those that have a text with a word
    number = {x: i for i, x in enumerate(langs)}
    truth_of = np.array([number.get(x, 0) for x in told], np.int64)
    unique, at, word_no = np.unique(h, return_index=True, return_inverse=True)
    word_no = word_no.ravel()
    place, sizes = [], []
    for i in range(0, len(unique), PORTION):
        few = at[i : i + PORTION]
        where, first = features(data, start[few], stop[few], unique[i : i + PORTION])
        place.append(where.astype(np.int32))
        sizes.append(np.diff(np.append(first, len(where))))
    place, sizes = np.concatenate(place), np.concatenate(sizes)
    begin, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(unique), dtype=np.int32), sizes)
    truth, k = truth_of[text_no], len(langs)
    share = np.bincount(truth, minlength=k)
    importance = (len(truth) / k / np.maximum(share, 1))[truth]  # languages count alike
    weights, trans = np.zeros((TABLE, k)), np.zeros((k, k))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, trans)]
    seen = np.zeros((k, k))
    inner = np.flatnonzero(np.diff(text_no, prepend=-1) == 0)
    np.add.at(seen, (truth[inner - 1], truth[inner]), 1)
    portions = list(_whole(text_no))
    for i in range(1, rounds + 1):
        scores = np.column_stack([np.add.reduceat(weights[place, j], begin) for j in range(k)])
        by_word, expected = np.zeros((len(unique), k)), np.zeros((k, k))
        for part in portions:
            post, passed = marginals(scores[word_no[part]], text_no[part], trans)
            miss = -post
            miss[np.arange(len(miss)), truth[part]] += 1
            miss *= importance[part, None]
            by_word += np.column_stack([np.bincount(word_no[part], miss[:, j], len(unique)) for j in range(k)])
            expected += passed
        grad = np.column_stack([np.bincount(place, by_word[owner, j], TABLE) for j in range(k)]) / len(truth)
        for x, g, (m, v) in ((weights, grad - decay * weights / len(truth), state[0]), (trans, (seen - expected) / len(truth) - decay * trans, state[1])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-6)
    return {"langs": langs, "weights": weights.astype(np.float32), "trans": np.clip(trans, -4, 4)}


def _labelled(model: dict, column: pa.Array):
    """By chunk of a column: what _texts() gives, and the posteriors of each word."""
    for row, end, data, offsets, text, start, stop, h in _texts(column):
        if len(h):
            unique, at, back = np.unique(h, return_index=True, return_inverse=True)
            place, begin = features(data, start[at], stop[at], unique)
            emission = np.add.reduceat(model["weights"][place], begin)[back.ravel()]
            yield row, end, data, offsets, text, start, stop, marginals(emission, text, model["trans"], False)[0]


def predict(model: dict, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and mean posterior of each text of a column."""
    langs, names, out = model["langs"], [UNKNOWN] * len(column), np.zeros(len(column))
    if not langs:
        return names, out
    for row, end, data, offsets, text, _, _, post in _labelled(model, column):
        n = np.bincount(text, minlength=end - row)
        mean = np.column_stack([np.bincount(text, post[:, j], end - row) for j in range(len(langs))]) / np.maximum(n, 1)[:, None]
        plain = np.concatenate([[0], np.cumsum((data < 128) & LETTERS[data])])[offsets]
        for i in np.flatnonzero(n).tolist():
            if plain[i + 1] > plain[i] or any(c.isalpha() for c in column[row + i].as_py()):
                best = int(mean[i].argmax())
                names[row + i], out[row + i] = langs[best], min(1.0, float(mean[i, best]))
    return names, out


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, rows_per_language: int = 150) -> dict:
    """The model, from about rows_per_language whole texts of each language, drawn by a hash of doc_id among those not held out.

    The bound holds for what is fitted on; every text is predicted.
    """
    small_batches(docs.sparkSession)
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.groupBy("lang").count()
    part = F.least(F.lit(1.0), F.lit(float(rows_per_language)) / F.col("count"))
    rates = {r["lang"]: r["p"] for r in counts.select("lang", part.alias("p")).collect()}
    if not rates:
        return dict(EMPTY)
    rate = F.element_at(F.create_map(*(x for k, v in rates.items() for x in (F.lit(k), F.lit(v)))), F.col("lang"))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.where(draw < rate).select("doc_id", "lang", F.col("text").cast("string")).toArrow()
    model = fit(sample.sort_by([("lang", "ascending"), ("doc_id", "ascending")]))
    del sample
    _give_back()
    return model


def languages(docs: DataFrame, rows_per_language: int = 150) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score (mean posterior of that language over the text's words).

    Null texts and texts without a letter get 'und' and 0, as do all texts if no row has a language to learn from. A null doc_id is
    not held out. Predictions look at the text alone. Other columns are not looked at; an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, rows_per_language))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score = predict(model.value, batch.column(2).cast(pa.large_string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def language_spans(docs: DataFrame, rows_per_language: int = 150) -> DataFrame:
    """doc_id, start, end, n_words, lang, score: the runs of words of one language of each text of docs(doc_id, text, lang).

    start and end (exclusive) are code points; a word is labelled with the language of its largest posterior, and score is the mean of a
    run's. Texts without a word, and all texts if there is no language to learn from, have no runs. Repeated rows have theirs repeated.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, rows_per_language))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not model.value["langs"]:
                continue
            for row, _, data, offsets, text, start, stop, post in _labelled(model.value, batch.column(1)):
                best, score = post.argmax(1), post.max(1)
                first = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(best, prepend=-1) != 0))
                last = np.append(first[1:], len(text)) - 1
                point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
                zero = point[offsets[text[first]]]
                n = last - first + 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(text[first] + row)), pa.array(point[start[first]] - zero), pa.array(point[stop[last]] - zero), pa.array(n), pa.array([model.value["langs"][i] for i in best[first].tolist()]), pa.array(np.add.reduceat(score, first) / n)],
                    ["doc_id", "start", "end", "n_words", "lang", "score"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, start long, end long, n_words long, lang string, score double")


def in_a_language(docs: DataFrame, least: float = 0.35, rows_per_language: int = 150) -> DataFrame:
    """docs without texts that have no letter or in which no language has the mean posterior `least`, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, rows_per_language))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score = predict(model.value, batch.column(at).cast(pa.large_string()))
            yield batch.filter(pa.array((np.array(names) != UNKNOWN) & (score >= least)))

    return docs.mapInArrow(run, docs.schema)

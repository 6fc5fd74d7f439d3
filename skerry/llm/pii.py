"""Personal data: patterns, and a linear-chain conditional random field over word shapes that adds to them."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.text import text_slices

KINDS = ("email", "ip", "card", "phone")
#: Outside, and for each kind the first and the later words of a span.
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
FEATURES = 4096
#: Words of a run that are decoded in one go; a longer run is decoded whole, in parts of so many.
PART = 200
#: A span is added if each of its words belongs to one with this probability at least.
SURE = 0.9
#: Documents that labels are taken from, at most, and runs of words of them.
SAMPLE_DOCS, SAMPLE_RUNS = 2_000, 1_500

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BLANK, MARK = re.compile(r"[\x20\x09-\x0D]"), re.compile("[0-9@+]")

# Examples of spans, [kind: ...] in each line, that the patterns do not find.
EXAMPLES = """
call [phone: (030) 555-7713] today
tel. [phone: 555-201-7713] or [phone: 555.201.7713]
dial [phone: (212) 555-0134] or write
phone [phone: 020-555-0123] ask for
reach us at [phone: (415) 555-2671] weekdays
the offices [phone: 030-555-4471] and [phone: (089) 555-1203] are open
in 2019 and 2020 the 15 of 3,000 were 12.5% of it
version 1.2.3 of 2021-05-17 has 40-60 items
room 12-345 on page 99 at 10:30 costs 1,299.00
ref 12345-67 and AB-123-456 of 1999/2000
item 3.14159 x 10 = 31.4 and 7+5 is 12
id 20210517123000123456 of batch 77-12 in row 9
"""


def luhn(digits: str) -> bool:
    value = np.frombuffer(digits.encode(), np.uint8)[::-1].astype(np.int64) - 48
    double = value[1::2] * 2
    return int(value[::2].sum() + (double - 9 * (double > 9)).sum()) % 10 == 0


def patterns(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) by the patterns: leftmost, not overlapping within a kind."""
    spans = []
    end, at = 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        start = at
        while domain and start > end and LOCAL_END.match(text, start - 1):
            start -= 1
        if domain and start < at:
            end = domain.end()
            spans.append((start, end, "email"))
        at = text.find("@", max(at + 1, end))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            spans.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans.append((*m.span(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                spans.append((*m.span(), "phone"))
    return spans


def runs(text: str) -> list[list[tuple[int, int]]]:
    """Words that hold a digit, @ or +, as runs of neighbours. All other words are outside any span,
    so the chain falls apart at them and each run can be decoded on its own, exactly."""
    out, end = [], 0
    for m in MARK.finditer(text):
        if m.start() < end:
            continue
        start = m.start()
        while start > end and not BLANK.match(text, start - 1):
            start -= 1
        stop = BLANK.search(text, m.start())
        stop = stop.start() if stop else len(text)
        if out and not text[end:start].strip(" \t\n\x0b\f\r"):
            out[-1].append((start, stop))
        else:
            out.append([(start, stop)])
        end = stop
    return out


def features(word: str) -> tuple[int, ...]:
    """Hashed features of a word's shape: letters and digits by class, runs of one class cut to three;
    of the shape of a long word the first 64 characters, all else of the whole word."""
    core = word.strip(".,;:!?\"'*#$%&|<>")
    shape = re.sub("[0-9]", "9", re.sub(r"[^\W\d_]", "a", re.sub("[A-Z]", "A", core)))
    short = re.sub(r"(.)\1{3,}", r"\1\1\1", shape)
    digits = sum(c == "9" for c in shape)
    own = (short[:64], f"digits {min(digits, 20)}", f"length {min(len(core), 30)}", f"first {short[:2]}", f"last {short[-2:]}",
           f"signs {''.join(sorted(set(re.sub('[aA9]', '', shape))))}", "long" if len(word) > 64 else "all")
    return tuple(zlib.crc32(f.encode()) % FEATURES for f in own)


@dataclass
class Crf:
    weights: np.ndarray  # features x labels
    moves: np.ndarray  # label to label; row and column 0 hold the outside on both ends of a run

    def scores(self, words: list[tuple[int, ...]]) -> np.ndarray:
        return np.array([self.weights[list(f)].sum(axis=0) for f in words])


FORBIDDEN = np.array([[b.startswith("I-") and a[2:] != b[2:] for b in LABELS] for a in LABELS])


def padded(scores: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(s) for s in scores])
    out = np.zeros((len(scores), lengths.max(), len(LABELS)))
    for i, s in enumerate(scores):
        out[i, :len(s)] = s
    return out, lengths


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def most(x: np.ndarray, axis: int) -> np.ndarray:
    return x.max(axis=axis)


def ends(moves: np.ndarray, parts: list[np.ndarray], fold: Callable[[np.ndarray, int], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each of the successive parts of one run, given by their scores, what the words before it
    add to the labels of its first word, and those after it to the labels of its last (part, label):
    by log_sum over all of their paths, for marginals(), or by the most of one, for viterbi().

    Each part is crossed once, from every label before it to every label of its last word, all parts
    at the same time; then the crossings are put one after the other. Numbers common to all labels
    are left out, as they change neither probabilities nor the best path."""
    scores, lengths = padded(parts)
    across = moves + scores[:, 0, None]
    for t in range(1, scores.shape[1]):
        on = fold(across[..., None] + moves, 2) + scores[:, t, None]
        across = np.where((t < lengths)[:, None, None], on, across)
    first, last = np.empty((2, len(parts), len(LABELS)))
    first[0], last[-1] = moves[0], moves[:, 0]
    before = across[0, 0]
    for k in range(1, len(parts)):
        before = before - before.max()
        first[k] = fold(before[:, None] + moves, 0)
        before = fold(before[:, None] + across[k], 0)
    for k in range(len(parts) - 2, -1, -1):
        last[k] = fold(across[k + 1] + last[k + 1], 1)
        last[k] -= last[k].max()
    return first, last


def marginals(moves: np.ndarray, scores: np.ndarray, lengths: np.ndarray, first: np.ndarray | None = None,
              last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of labels (run, word, label), and the expected moves of all runs, by forward-backward.

    Rows are whole runs or, with `first` and `last` of ends(), parts; the moves of parts mean nothing."""
    runs_, longest, labels = scores.shape
    first, after = moves[0] if first is None else first, np.broadcast_to(moves[:, 0] if last is None else last, (runs_, labels))
    forward, backward = np.zeros_like(scores), np.zeros_like(scores)
    forward[:, 0] = first + scores[:, 0]
    for t in range(1, longest):
        forward[:, t] = log_sum(forward[:, t - 1, :, None] + moves[None], 1) + scores[:, t]
    last = lengths - 1
    for t in range(longest - 1, -1, -1):
        if t < longest - 1:
            on = log_sum(moves[None] + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where((last == t)[:, None], after, on)
        else:
            backward[:, t] = after
    whole = log_sum(forward[np.arange(runs_), last] + after, 1)
    inside = np.arange(longest)[None] < lengths[:, None]
    own = np.where(inside[..., None], np.exp(forward + backward - whole[:, None, None]), 0.0)
    expected = np.zeros_like(moves)
    for t in range(longest - 1):
        pair = forward[:, t, :, None] + moves[None] + (scores[:, t + 1] + backward[:, t + 1])[:, None, :] - whole[:, None, None]
        expected += np.exp(np.where(inside[:, t + 1, None, None], pair, -np.inf)).sum(axis=0)
    expected[0] += own[:, 0].sum(axis=0)
    expected[:, 0] += own[np.arange(runs_), last].sum(axis=0)
    return own, expected


def viterbi(moves: np.ndarray, scores: np.ndarray, lengths: np.ndarray, first: np.ndarray | None = None,
            last: np.ndarray | None = None) -> np.ndarray:
    """Best labels (run, word) of a batch of runs, or of parts with `first` and `last` of ends();
    beyond a run's length they mean nothing."""
    runs_, longest, _ = scores.shape
    best = (moves[0] if first is None else first) + scores[:, 0]
    back = np.zeros(scores.shape, dtype=np.int64)
    final = best.copy()
    for t in range(1, longest):
        options = best[:, :, None] + moves[None]
        back[:, t] = options.argmax(axis=1)
        best = options.max(axis=1) + scores[:, t]
        final = np.where((lengths - 1 == t)[:, None], best, final)
    path = np.zeros((runs_, longest), dtype=np.int64)
    label = (final + (moves[:, 0] if last is None else last)).argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        here = lengths - 1 >= t
        path[here, t] = label[here]
        label = np.where(here & (t > 0), back[np.arange(runs_), t, label], label)
    return path


def train(examples: list[tuple[list[tuple[int, ...]], list[int]]], rounds: int = 80, penalty: float = 0.02) -> Crf:
    """By gradient ascent on the log-likelihood of labelled runs, step sizes by past gradients."""
    weights, moves = np.zeros((FEATURES, len(LABELS))), np.zeros((len(LABELS), len(LABELS)))
    moves[FORBIDDEN] = -1e4
    if not examples:
        return Crf(weights, moves)
    model, past_w, past_m = Crf(weights, moves), np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)
    true_w, true_m = np.zeros_like(weights), np.zeros_like(moves)
    flat = np.array([f for words, _ in examples for f in words])
    for words, labels in examples:
        for f, label in zip(words, labels, strict=True):
            np.add.at(true_w[:, label], list(f), 1)
        for a, b in zip([0, *labels], [*labels, 0], strict=True):
            true_m[a, b] += 1
    lengths = np.array([len(words) for words, _ in examples])
    for _ in range(rounds):
        scores, _ = padded(np.split(model.weights[flat].sum(axis=1), np.cumsum(lengths)[:-1]))
        own, expected = marginals(model.moves, scores, lengths)
        inside = np.arange(scores.shape[1])[None] < lengths[:, None]
        found = np.zeros_like(weights)
        np.add.at(found, flat, own[inside][:, None, :].repeat(flat.shape[1], axis=1))
        for value, true, gained, past in ((model.weights, true_w, found, past_w), (model.moves, true_m, expected, past_m)):
            gradient = true - gained - penalty * np.where(value < -1e3, 0, value)
            past += gradient ** 2
            value += 0.5 * gradient / np.sqrt(past)
        model.moves[FORBIDDEN] = -1e4
    return model


def labelled(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[list[tuple[int, ...]], list[int]]]:
    """Runs of a text as features and labels: a word that overlaps a span has its kind."""
    out = []
    for words in runs(text):
        labels, before = [], None
        for start, stop in words:
            own = next((s for s in spans if s[0] < stop and start < s[1]), None)
            labels.append(0 if own is None else LABELS.index(("I-" if own == before else "B-") + own[2]))
            before = own
        out.append(([features(text[a:b]) for a, b in words], labels))
    return out


def example_rows() -> list[tuple[str, list[tuple[int, int, str]]]]:
    """EXAMPLES as texts and spans."""
    rows = []
    for line in EXAMPLES.strip().splitlines():
        text, spans = "", []
        for part in re.split(r"(\[\w+: [^\]]+\])", line):
            m = re.fullmatch(r"\[(\w+): ([^\]]+)\]", part)
            if m:
                spans.append((len(text), len(text) + len(m[2]), m[1]))
            text += m[2] if m else part
        rows.append((text, spans))
    return rows


def train_on(docs: DataFrame) -> Crf:
    """From EXAMPLES and a bounded sample of `docs`: at most SAMPLE_RUNS runs of at most SAMPLE_DOCS
    texts, labelled by the patterns. Texts with a digit and below 20,000 characters are drawn by the
    digest of doc_id and text, runs of up to 12 words are taken.

    Such texts are counted, and drawn by a digest bound that the count sets, a quarter more than is
    wanted, so those that meet in one task do not grow with the table or its splits; copies collapse
    before that."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where((F.length("text") < 20_000) & F.col("text").rlike("[0-9]"))
    total, reach = texts.count(), 1 << 40
    digest = F.pmod(F.xxhash64("doc_id", "text"), F.lit(reach))
    some = (texts.where(digest < min(reach, 5 * SAMPLE_DOCS * reach // (4 * max(total, 1))))
            .distinct().orderBy(digest, "doc_id", "text").limit(SAMPLE_DOCS).select("text"))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for text in batch.column("text").to_pylist() for x in labelled(text, patterns(text)) if len(x[0]) <= 12]
            yield pa.RecordBatch.from_pydict({
                "words": pa.array([[list(f) for f in w] for w, _ in found], pa.list_(pa.list_(pa.int32()))),
                "labels": pa.array([y for _, y in found], pa.list_(pa.int32()))})

    rows = some.mapInArrow(label, "words array<array<int>>, labels array<int>").orderBy(F.xxhash64("words"), "labels").limit(SAMPLE_RUNS).collect()
    examples = [([tuple(f) for f in r["words"]], list(r["labels"])) for r in rows]
    own = [x for text, spans in example_rows() for x in labelled(text, spans)]
    return train(examples + own * 5)


def added(model: Crf, texts: list[str], known: list[list[tuple[int, int, str]]]) -> list[list[tuple[int, int, str]]]:
    """Spans that the model finds in each text besides the known ones, which they never overlap."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    of_text = [(i, words) for i, text in enumerate(texts) for words in runs(text)]
    todo, cache = [(k, low) for k, (_, words) in enumerate(of_text) for low in range(0, len(words), PART)], {}
    todo.sort(key=lambda x: len(of_text[x[0]][1]))  # parts of a run stay together, in their order
    labels_of, sure_of = ([np.zeros(len(words), d) for _, words in of_text] for d in (np.int8, bool))

    def emitted(k: int, low: int) -> np.ndarray:
        i, words = of_text[k]
        rows = []
        for a, b in words[low:low + PART]:
            f = features(texts[i][a:b])
            if f not in cache:
                cache[f] = model.weights[list(f)].sum(axis=0)
            rows.append(cache[f])
        return np.array(rows)

    own_ends = (model.moves[0], model.moves[:, 0])
    run_ends, now = {}, None
    for at in range(0, len(todo), 512):
        part, own, bounds = todo[at:at + 512], [], []
        for k, low in part:
            if len(of_text[k][1]) <= PART:
                own.append(emitted(k, low))
                bounds.append(own_ends * 2)
                continue
            if k != now:
                now, held = k, [emitted(k, x) for x in range(0, len(of_text[k][1]), PART)]
                run_ends = list(zip(*ends(model.moves, held, most), *ends(model.moves, held, log_sum), strict=True))
            own.append(held[low // PART])
            bounds.append(run_ends[low // PART])
        scores, lengths = padded(own)
        b = [np.array(x) for x in zip(*bounds, strict=True)]
        paths, (p, _) = viterbi(model.moves, scores, lengths, *b[:2]), marginals(model.moves, scores, lengths, *b[2:])
        sure = np.take_along_axis(p, paths[..., None], 2)[..., 0] >= SURE
        for (k, low), n, path, s in zip(part, lengths, paths, sure, strict=True):
            labels_of[k][low:low + n], sure_of[k][low:low + n] = path[:n], s[:n]
    for (i, words), path, sure in zip(of_text, labels_of, sure_of, strict=True):
        at = 0
        while at < len(words):
            label = LABELS[path[at]]
            stop = at + 1
            if label != "O":
                while stop < len(words) and LABELS[path[stop]] == "I-" + label[2:]:
                    stop += 1
                start, end = words[at][0], words[stop - 1][1]
                inner = texts[i][start:end]
                start += len(inner) - len(inner.lstrip("\"'.,;:!?*#$%&|<>"))
                end -= len(inner) - len(inner.rstrip("\"'.,;:!?*#$%&|<>("))
                if sure[at:stop].all() and start < end and not any(s[0] < end and start < s[1] for s in known[i]):
                    out[i].append((start, end, label[2:]))
            at = stop
    return out


def find_spans(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """doc_id, base and spans (arrays of start, end, kind; code points, end exclusive) of every row of (doc_id, text).

    `base` are the patterns' spans, `spans` these and the model's, both by kind as in KINDS, then
    start. The model is trained on `docs` unless given; it is a small table of weights. A null or
    empty text has none; repeated rows repeat; other columns are left out; an empty table gives no
    rows. No shuffle: texts are scanned whole, in bounded slices."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(train_on(docs) if model is None else model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered = lambda spans: [dict(zip(("start", "end", "kind"), s, strict=True)) for s in sorted(spans, key=lambda s: (KINDS.index(s[2]), s[0]))]
        for batch in batches:
            for rows in text_slices(batch):
                texts = [t or "" for t in rows.column("text").to_pylist()]
                base = [patterns(t) if MARK.search(t) else [] for t in texts]
                more = added(shared.value, texts, base)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": rows.column("doc_id"), "text": rows.column("text"),
                    "base": pa.array([ordered(b) for b in base], kind),
                    "spans": pa.array([ordered(b + m) for b, m in zip(base, more, strict=True)], kind)})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spans = "array<struct<start: long, end: long, kind: string>>"
    return texts.mapInArrow(find, f"doc_id long, text string, base {spans}, spans {spans}")


def masked(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """`docs` with each span of find_spans() in `text` replaced by its kind in brackets, columns and rows as they are.

    Overlapping spans are replaced together, by the kind of the first. Where there is a column
    n_chars, it is set to the new length for the texts that change. A null text stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(train_on(docs) if model is None else model)
    schema, names = docs.schema, docs.columns
    source = docs.toDF(*[f"_{i}" for i in range(len(names))])
    at = names.index("text")
    source = source.withColumn("text", F.col(f"_{at}").cast("string"))

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch):
                texts = rows.column("text").to_pylist()
                base = [patterns(t) if t and MARK.search(t) else [] for t in texts]
                more = added(shared.value, [t or "" for t in texts], base)
                out = []
                for text, spans in zip(texts, map(list.__add__, base, more), strict=True):
                    parts, end = [], 0
                    for start, stop, kind in sorted(spans):
                        if start >= end:
                            parts.append(f"{text[end:start]}[{kind}]")
                        end = max(end, stop)
                    out.append(text if not parts else "".join(parts) + text[end:])
                columns = [pa.array(out, pa.string()) if name == f"_{at}" else rows.column(name) for name in rows.schema.names[:-1]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([a != b for a, b in zip(out, texts, strict=True)])],
                                                 [*rows.schema.names[:-1], "changed"])

    kinds = ", ".join(f"_{i} {'string' if i == at else f.dataType.simpleString()}" for i, f in enumerate(schema))
    done = source.mapInArrow(replace, f"{kinds}, changed boolean")
    length = lambda i, f: F.when(F.col("changed"), F.length(f"_{at}")).otherwise(F.col(f"_{i}")).cast(f.dataType)
    return done.select(*[(length(i, f) if f.name == "n_chars" else F.col(f"_{i}")).alias(f.name) for i, f in enumerate(schema)])

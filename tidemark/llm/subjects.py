"""Subject areas of documents: averaged word and subword embeddings with independent logistic outputs.

A post is reduced to its own words (quotes, signatures and markup taken off) and cut into sentences. A sentence's vector
is the mean of its words' vectors, a word's the mean of the vectors of itself and its character n-grams, all hashed into one
table. Each subject has an independent logistic output per sentence; a post's output combines its sentences by a
soft maximum, so that one sentence on a second subject isn't lost in a long post.

At every step of the training each partition works out the gradient of its documents; the partitions' gradients are added up
block by block before they reach the driver, which moves the one model and sends it out again. What the driver gets in a step
is of the size of the model, which is fixed, whatever the number of partitions. Every document is scored.

Defined cases: NULL, empty and blank posts, and posts without own words have no subject; labels of documents that have no
row, and of subjects not asked for, are left out; a NULL label counts as a vote for no subject; without any label there is
no model and so no subject; repeated labels of a rater count once.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.sequence import lookup
from tidemark.session import settle, shuffle_parts

#: Size of the hashed table and of the vectors, character n-grams, steps and step size of training, the cutoff of an output.
BUCKETS, DIM, GRAMS, STEPS, RATE, CUTOFF = 1 << 16, 16, (3, 4, 5), 24, 0.15, 0.25
#: How close the soft maximum over sentences is to the greatest one, and the rate below which a word counts in full.
SHARPNESS, COMMON = 4.0, 0.003
#: Most labelled documents that are learned from (chosen by hash, so evenly), those of a partition, and the buckets of a block of gradients.
MOST_LABELLED, PART_LABELLED, BLOCK = 30_000, 1_500, 1 << 11
#: A closing line is a signature if so many posts mark it as one. A table of up to so many such lines is sent to the tasks, a larger one is joined.
SIGNATURE_SEEN, SIGNATURES_SENT = 3, 200_000

#: Opening and closing tags that can enclose a quote; those of the last kind do so only with the word in the opening tag.
_QUOTE_TAGS = [re.compile(r"\[(/?)(quote)[^\]]*\]", re.I), re.compile(r"<(/?)(blockquote)[^>]*>", re.I), re.compile(r"<(/?)div([^>]*)>", re.I)]
_OPEN_QUOTE = re.compile(r"(?:\[quote[^\]]*\]|<blockquote[^>]*>).*?(?:\n\s*\n|$)", re.I | re.S)
_SIGNATURE = re.compile(r"\[sig\](.*?)\[/sig\]", re.I | re.S)
_RULE = re.compile(r"^\s*(?:-{2,3}|_{3,}|—{1,3}|={3,}|\*{3,})\s*$")
_WROTE = re.compile(r"^\s*\S{1,40}(?: \S{1,20})? (?:wrote|schrieb|escribió|写道)\s*[:：]\s*$", re.I)
_TAG = re.compile(r"\[/?(?:url|b|i|u|s|color|size|font|img|code|quote|sig|list|\*)\b[^\]]*\]|</?[a-zA-Z][^<>]{0,200}>", re.I)
_BREAK = re.compile(r"<br\s*/?>|</p>|\r\n?|[\u2028\u2029\x85\x0b\x0c]", re.I)
_ODD_BREAK = re.compile("[<\r\u2028\u2029\x85\x0b\x0c]")
#: What every text with a marked signature contains.
_MARKED = r"(?i)\[sig\]|--|___|—|===|\*\*\*"
_LINK = re.compile(r"https?://\S+|www\.\S+", re.I)
_WORD = re.compile(r"[^\W_]+")
_HAN = re.compile(r"[㐀-鿿]+")
_SPECIAL = re.compile(r"[\d㐀-鿿]")
_END = re.compile(r"[.!?。！？…;；]+(?:\s|$)|[。！？；]")
_LEET = str.maketrans("0134578", "oieastb")


def _without_quotes(text: str, tags: re.Pattern[str]) -> str:
    """The text without what matching tags enclose, nested ones included, in one pass."""
    open_at: list[tuple[int, bool]] = []
    cuts: list[tuple[int, int]] = []
    for m in tags.finditer(text):
        if not m.group(1):
            open_at.append((m.start(), "quote" in m.group(2).lower()))
        elif open_at:
            start, quote = open_at.pop()
            if quote:
                while cuts and cuts[-1][0] > start:
                    cuts.pop()
                cuts.append((start, m.end()))
    if not cuts:
        return text
    ends = [0, *[b for _, b in cuts]]
    return "\n".join(text[a:b] for a, b in zip(ends, [*[a for a, _ in cuts], len(text)]))


def _lines(text: str) -> tuple[list[str], list[str]]:
    """(own lines, marked signature lines), quotes taken off, tags left in. Patterns are only tried on texts that hold their first characters."""
    t = _BREAK.sub("\n", text) if _ODD_BREAK.search(text) else text
    square, angle = "[" in t, "<" in t
    for tags, able in zip(_QUOTE_TAGS, (square, angle, angle)):
        if able:
            t = _without_quotes(t, tags)
    if square or angle:
        t = _OPEN_QUOTE.sub("\n", t)
    signs: list[str] = []
    if square:
        signs = [line for m in _SIGNATURE.findall(t) for line in m.split("\n")]
        t = _SIGNATURE.sub("\n", t)
    own = []
    lines = t.split("\n")
    for n, line in enumerate(lines):
        bare = line.strip()
        if bare[:1] in _RULE_SIGNS and _RULE.match(line) and 0 < sum(1 for x in lines[n + 1 :] if x.strip()) <= 3:
            signs += lines[n + 1 :]
            break
        if bare.startswith((">", "&gt;", "|", "»")) or (bare[-1:] in (":", "：") and _WROTE.match(line)):
            continue
        own.append(line)
    return own, signs


_RULE_SIGNS = frozenset("-_—=*")


def _plain(text: str) -> str:
    if "&" in text:
        text = html.unescape(text)
    return (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()


def plain_line(line: str) -> str:
    """A line for comparison: without tags, digits masked, plain width, lower case."""
    return re.sub(r"\s+", " ", re.sub(r"\d+", "#", _plain(_TAG.sub("", line)))).strip()


def line_hash(line: str) -> int:
    """A signed 64-bit hash of the line for comparison; 0 if there is nothing in it."""
    import xxhash

    plain = plain_line(line)
    return (xxhash.xxh64_intdigest(plain.encode("utf-8", "surrogatepass")) | 1) - (1 << 63) if plain else 0


def signature_lines(text: str | None) -> list[int]:
    return [h for h in map(line_hash, _lines(text)[1] if text else []) if h]


def own_lines(text: str | None) -> list[str]:
    return _lines(text)[0] if text and text.strip() else []


def without_signature(lines: list[str], signatures: frozenset[int]) -> list[str]:
    """The lines without those at the end that are blank or signatures."""
    n = len(lines)
    while n and (not lines[n - 1].strip() or (h := line_hash(lines[n - 1])) == 0 or h in signatures):
        n -= 1
    return lines[:n]


def sentences(lines: list[str]) -> list[list[str]]:
    """The words of each sentence of a post's own lines."""
    out = []
    for line in lines:
        if "[" in line or "<" in line:
            line = _TAG.sub(" ", line)
        if "&" in line:
            line = html.unescape(line)
        for part in _END.split(line):
            part = _plain(part)
            if "http" in part or "www." in part:
                part = _LINK.sub(" hyperlink ", part)
            if not _SPECIAL.search(part):
                if words := _WORD.findall(part):
                    out.append(words)
                continue
            plain = lambda w: w if w.isalpha() or not any(map(str.isdigit, w)) else w.translate(_LEET)
            words = []
            for w in _WORD.findall(part) if _HAN.search(part) else ():
                runs = _HAN.findall(w)
                if runs:
                    for r in runs:
                        words += [r[i : i + 2] for i in range(len(r) - 1)] or [r]
                elif not w.isdigit():
                    words.append(plain(w))
            words = words or [plain(w) for w in _WORD.findall(part) if not w.isdigit()]
            if words:
                out.append(words)
    return out


def own_sentences(text: str | None, signatures: frozenset[int] = frozenset()) -> list[list[str]]:
    """The words of each sentence of the post's own text."""
    return sentences(without_signature(own_lines(text), signatures))


def _hash(s: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) % BUCKETS


def features(word: str) -> list[int]:
    """Buckets of the word and its character n-grams."""
    if _HAN.match(word):
        return [_hash(word), *[_hash(f"<{c}>") for c in word]]
    marked = f"<{word}>"
    return [_hash(word), *[_hash(marked[i : i + n]) for n in GRAMS for i in range(len(marked) - n + 1)]]


@dataclass
class Batch:
    """Documents in index form: words' features, sentences' words, documents' sentences; ``votes`` are the soft labels."""

    feats: np.ndarray
    feat_word: np.ndarray
    words: np.ndarray
    word_sentence: np.ndarray
    word_weight: np.ndarray
    sentence_doc: np.ndarray
    n_docs: int
    votes: np.ndarray | None = None
    weight: np.ndarray | None = None


def batch(documents: list[list[list[str]]], rarity: np.ndarray, known: dict[str, list[int]] | None = None) -> Batch:
    """``rarity`` holds the weight of a word by its bucket."""
    index: dict[str, int] = {}
    words, word_sentence, sentence_doc = [], [], []
    for d, sentences in enumerate(documents):
        for s in sentences:
            n = len(sentence_doc)
            sentence_doc.append(d)
            for w in s:
                words.append(index.setdefault(w, len(index)))
                word_sentence.append(n)
    known = {} if known is None else known
    lists = [known[w] if w in known else known.setdefault(w, features(w)) for w in index]
    feats = np.fromiter((f for x in lists for f in x), np.int64)
    feat_word = np.repeat(np.arange(len(lists)), [len(x) for x in lists]) if lists else np.zeros(0, np.int64)
    as_int = lambda x: np.asarray(x, np.int64)
    weight = np.asarray([rarity[x[0]] for x in lists], np.float32)[as_int(words)] if words else np.zeros(0, np.float32)
    return Batch(feats, feat_word, as_int(words), as_int(word_sentence), weight, as_int(sentence_doc), len(documents))


def _mean(values: np.ndarray, group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Means of rows by sorted group, and the group sizes."""
    sizes = np.bincount(group, minlength=n).astype(np.float32)
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(group):
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        out[group[starts]] = np.add.reduceat(values, starts, axis=0)
    return out / np.maximum(sizes, 1)[:, None], sizes


def forward(b: Batch, table: np.ndarray, out: np.ndarray, bias: np.ndarray):
    """Log odds per document and subject, with what the backward step needs."""
    n_words = int(b.feat_word[-1]) + 1 if len(b.feat_word) else 0
    vectors, per_word = _mean(table[b.feats], b.feat_word, n_words)
    sums, per_sentence = _mean(vectors[b.words] * b.word_weight[:, None], b.word_sentence, len(b.sentence_doc))
    shares, _ = _mean(b.word_weight[:, None], b.word_sentence, len(b.sentence_doc))
    scale = 1 / np.maximum(shares, 1e-6)
    sentences = sums * scale
    odds = sentences @ out + bias
    top = np.full((b.n_docs, out.shape[1]), -30.0, np.float32)
    starts = np.flatnonzero(np.r_[True, b.sentence_doc[1:] != b.sentence_doc[:-1]]) if len(b.sentence_doc) else np.zeros(0, np.int64)
    if len(starts):
        top[b.sentence_doc[starts]] = np.maximum.reduceat(odds, starts, axis=0)
    share = np.exp(SHARPNESS * (odds - top[b.sentence_doc]))
    total = np.ones_like(top)
    if len(starts):
        total[b.sentence_doc[starts]] = np.add.reduceat(share, starts, axis=0)
    return top + np.log(total) / SHARPNESS, (per_word, np.maximum(per_sentence, 1)[:, None] / scale, sentences, share / total[b.sentence_doc])


def gradient(b: Batch, table: np.ndarray, out: np.ndarray, bias: np.ndarray):
    """(touched buckets, their gradients, of the outputs, of the bias, loss, weight), summed over the documents."""
    odds, (per_word, divisor, sentences, share) = forward(b, table, out, bias)
    p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    loss = -(b.votes * np.log(p + 1e-7) + (1 - b.votes) * np.log(1 - p + 1e-7)) * b.weight[:, None]
    d_odds = ((p - b.votes) * b.weight[:, None])[b.sentence_doc] * share
    d_sentence = (d_odds @ out.T) / divisor
    order = np.argsort(b.words, kind="stable")
    d_word = np.zeros((len(per_word), table.shape[1]), np.float32)
    if len(order):
        sorted_words = b.words[order]
        starts = np.flatnonzero(np.r_[True, sorted_words[1:] != sorted_words[:-1]])
        d_word[sorted_words[starts]] = np.add.reduceat(d_sentence[b.word_sentence[order]] * b.word_weight[order][:, None], starts, axis=0)
    d_word /= np.maximum(per_word, 1)[:, None]
    order = np.argsort(b.feats, kind="stable")
    touched = np.zeros(0, np.int64)
    d_table = np.zeros((0, table.shape[1]), np.float32)
    if len(order):
        sorted_feats = b.feats[order]
        starts = np.flatnonzero(np.r_[True, sorted_feats[1:] != sorted_feats[:-1]])
        touched, d_table = sorted_feats[starts], np.add.reduceat(d_word[b.feat_word[order]], starts, axis=0)
    return touched, d_table.astype(np.float32), (sentences.T @ d_odds).astype(np.float32), d_odds.sum(0).astype(np.float32), float(loss.sum()), float(b.weight.sum())


@dataclass
class Model:
    subjects: list[str]
    table: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    rarity: np.ndarray

    def scores(self, documents: list[list[list[str]]], known: dict[str, list[int]] | None = None) -> np.ndarray:
        odds = forward(batch(documents, self.rarity, known), self.table, self.out, self.bias)[0]
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


class Adam:
    """Steps of one array by its gradients' first two moments."""

    def __init__(self, shape: tuple[int, ...], rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(shape, np.float32), np.zeros(shape, np.float32), 0, rate

    def step(self, x: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.01 * (g * g - self.v)
        return x - self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)


def fresh(subjects: list[str], rarity: np.ndarray) -> Model:
    rng = np.random.default_rng(7)
    table = rng.uniform(-0.5, 0.5, (BUCKETS, DIM)).astype(np.float32)
    out = rng.normal(0, 0.5, (DIM, len(subjects))).astype(np.float32)
    return Model(subjects, table, out, np.full(len(subjects), -3.0, np.float32), rarity)


def fit(subjects: list[str], rarity: np.ndarray, gradients, steps: int = STEPS, rate: float = RATE, decay: float = 1e-4) -> Model:
    """``gradients(model)`` gives the partitions' ``gradient`` results; their sum moves the model."""
    model = fresh(subjects, rarity)
    movers = [Adam(model.table.shape, rate), Adam(model.out.shape, rate), Adam(model.bias.shape, rate)]
    for step in range(steps):
        d_table, d_out, d_bias, weight = np.zeros_like(model.table), np.zeros_like(model.out), np.zeros_like(model.bias), 1e-9
        for touched, part, o, b, _, w in gradients(model):
            d_table[touched] += part
            d_out += o
            d_bias += b
            weight += w
        slower = 1 - step / steps
        for m in movers:
            m.rate = rate * slower
        model.table = movers[0].step(model.table, d_table / weight + decay * 0.01 * model.table)
        model.out = movers[1].step(model.out, d_out / weight + decay * model.out)
        model.bias = movers[2].step(model.bias, d_bias / weight)
    return model


def votes(labels: DataFrame, ident: str, subject: str, rater: str, subjects: list[str]) -> DataFrame:
    """(_id, _votes): per labelled document the share of its raters for each subject, in the order of ``subjects``."""
    told = labels.where(F.col(ident).isNotNull()).groupBy(F.col(ident).alias("_id"), F.coalesce(F.col(rater).cast("string"), F.lit("")).alias("_rater")).agg(F.collect_set(subject).alias("_said"))
    shares = F.array(*[F.avg(F.array_contains("_said", s).cast("double")) for s in subjects])
    return told.groupBy("_id").agg(shares.alias("_votes"))


def _signatures(documents: DataFrame) -> DataFrame:
    """(_hash) of the lines that at least SIGNATURE_SEEN posts mark as their signature, counted over all posts."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [x for t in b.column("_text").to_pylist() for x in set(signature_lines(t))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["_hash"])

    marked = documents.where(F.col("_text").rlike(_MARKED)).select("_text")
    return marked.mapInArrow(lines, "_hash bigint").groupBy("_hash").count().where(F.col("count") >= SIGNATURE_SEEN).select("_hash")


class _Counter:
    """In how many documents each bucket's words occur; comes out as one row at the end of a partition."""

    def __init__(self) -> None:
        self.seen, self.buckets = np.zeros(BUCKETS + 1, np.int64), {}

    def add(self, own: list[list[str]]) -> None:
        known = self.buckets
        at = {known[w] if w in known else known.setdefault(w, _hash(w)) for s in own for w in s}
        self.seen[list(at)] += 1
        self.seen[BUCKETS] += 1
        if len(known) > 500_000:
            known.clear()

    def row(self, kind: pa.DataType) -> pa.RecordBatch:
        at = np.flatnonzero(self.seen)
        return pa.RecordBatch.from_arrays([pa.array([None], kind), pa.array([None], pa.list_(pa.string())), pa.array([at], pa.list_(pa.int64())), pa.array([self.seen[at]], pa.list_(pa.int64()))], names=["_id", "_own", "_bucket", "_n"])


def _reduce(rows: DataFrame, column: str, sentences_of) -> DataFrame:
    """(_id, _own, _bucket, _n): each document's own sentences as words joined by blanks, and a row of word counts (_bucket, _n) per partition; settled."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, kind = _Counter(), None
        for b in batches:
            kind, packed = b.column("_id").type, []
            for row in zip(*[b.column(c).to_pylist() for c in column.split()]):
                own = sentences_of(*row)
                counter.add(own)
                packed.append([" ".join(s) for s in own])
            none = pa.nulls(len(packed), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(packed, pa.list_(pa.string())), none, none], names=["_id", "_own", "_bucket", "_n"])
        if kind is not None:
            yield counter.row(kind)

    return settle(rows.select("_id", *column.split()).mapInArrow(reduce, f"_id {rows.schema['_id'].dataType.simpleString()}, _own array<string>, _bucket array<bigint>, _n array<bigint>"))


def _reduced(documents: DataFrame, sent: int | None = None) -> DataFrame:
    """``_reduce`` of the documents without their signatures."""
    found = _signatures(documents)
    some = [r["_hash"] for r in found.limit((SIGNATURES_SENT if sent is None else sent) + 1).collect()]
    if len(some) <= (SIGNATURES_SENT if sent is None else sent):
        signatures = documents.sparkSession.sparkContext.broadcast(frozenset(some))
        return _reduce(documents, "_text", lambda text: own_sentences(text, signatures.value))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = [own_lines(t) for t in b.column("_text").to_pylist()]
            hashes = [[line_hash(x) for x in own] for own in lines]
            yield pa.RecordBatch.from_arrays([b.column("_row"), b.column("_id"), pa.array(lines, pa.list_(pa.string())), pa.array(hashes, pa.list_(pa.int64()))], names=["_row", "_id", "_lines", "_hashes"])

    numbered = documents.withColumn("_row", F.monotonically_increasing_id()).select("_row", "_id", "_text")
    parts = settle(numbered.mapInArrow(split, f"_row bigint, _id {documents.schema['_id'].dataType.simpleString()}, _lines array<string>, _hashes array<bigint>"))
    lines = parts.select("_row", F.posexplode("_hashes").alias("_at", "_hash")).where("_hash <> 0")
    other = lookup(lines, settle(found).withColumn("_sign", F.lit(True)), ["_hash"]).where("_sign IS NULL")
    kept = parts.join(other.groupBy("_row").agg((F.max("_at") + 1).alias("_keep")), "_row", "left").withColumn("_keep", F.coalesce("_keep", F.lit(0)))
    return _reduce(kept, "_lines _keep", lambda own, keep: sentences(own[:keep]))


def _unpack(column: pa.Array) -> list[list[list[str]]]:
    return [[s.split(" ") for s in own] for own in column.to_pylist()]


def rarity(reduced: DataFrame) -> np.ndarray:
    """The weight of a word by its bucket: near 1 for rare words, small for those in many documents; counted over all documents."""
    counts = reduced.where("_bucket IS NOT NULL").select(F.explode(F.arrays_zip("_bucket", "_n")).alias("_c")).groupBy("_c._bucket").agg(F.sum("_c._n").alias("_n"))
    seen = np.zeros(BUCKETS + 1)
    for r in counts.collect():  # at most BUCKETS + 1 rows
        seen[r["_bucket"]] = r["_n"]
    return (COMMON / (COMMON + seen[:BUCKETS] / max(seen[BUCKETS], 1))).astype(np.float32)


def _added(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The sum of one block's gradients."""
    total = sum(np.frombuffer(x, np.float32) for x in table.column("_g").to_pylist())
    return pa.table({"_block": pa.array([key[0].as_py()], pa.int32()), "_g": pa.array([total.tobytes()], pa.binary())})


def train(reduced: DataFrame, ballots: DataFrame, subjects: list[str], weights: np.ndarray, most: int = MOST_LABELLED, steps: int = STEPS) -> Model | None:
    """Fit on the labelled documents (at most ``most``, chosen by hash); None if there are none."""
    chosen = settle(ballots.orderBy(F.xxhash64("_id"), "_id").limit(most))
    spark = reduced.sparkSession
    parts = max(1, min(shuffle_parts(spark), -(-chosen.count() // PART_LABELLED)))
    context, fields = spark.sparkContext, ["feats", "feat_word", "words", "word_sentence", "word_weight", "sentence_doc", "votes"]
    weights_sent = context.broadcast(weights)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = list(batches)
        own = [d for b in tables for d in _unpack(b.column("_own"))]
        if own:
            b = batch(own, weights_sent.value)
            b.votes = np.asarray([v for t in tables for v in t.column("_votes").to_pylist()], np.float32)
            yield pa.RecordBatch.from_arrays([*[pa.array([getattr(b, f).tobytes()], pa.binary()) for f in fields], pa.array([b.n_docs], pa.int32())], names=[*fields, "n"])

    # one row per partition: its documents in index form, so that a step only reads arrays
    told = reduced.where(F.size("_own") > 0).join(chosen, "_id").select("_own", "_votes").repartition(parts)
    rows = settle(told.mapInArrow(index, ", ".join(f"{f} binary" for f in fields) + ", n int"))
    if rows.isEmpty():
        return None

    def gradients(model: Model) -> list[tuple]:
        sent = context.broadcast((model.table, model.out, model.bias))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in (r for b in batches for r in b.to_pylist()):
                ints = [np.frombuffer(row[f], np.int64) for f in ("feats", "feat_word", "words", "word_sentence", "sentence_doc")]
                b = Batch(*ints[:4], np.frombuffer(row["word_weight"], np.float32), ints[4], row["n"])
                b.votes, b.weight = np.frombuffer(row["votes"], np.float32).reshape(row["n"], -1), np.ones(row["n"], np.float32)
                touched, part, out, bias, loss, weight = gradient(b, *sent.value)
                table = np.zeros((BUCKETS, DIM), np.float32)
                table[touched] = part
                blocks = [*table.reshape(-1, BLOCK * DIM), np.concatenate([out.ravel(), bias.ravel(), np.asarray([loss, weight], np.float32)])]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([x.tobytes() for x in blocks], pa.binary())], names=["_block", "_g"])

        found = rows.mapInArrow(work, "_block int, _g binary").groupBy("_block").applyInArrow(_added, "_block int, _g binary").collect()  # the size of the model
        sent.destroy()
        at = {r["_block"]: np.frombuffer(bytes(r["_g"]), np.float32) for r in found}
        last, k = at.pop(BUCKETS // BLOCK), len(subjects)
        table = np.concatenate([at[i] for i in range(BUCKETS // BLOCK)]).reshape(BUCKETS, DIM)
        return [(np.arange(BUCKETS), table, last[: DIM * k].reshape(DIM, k), last[DIM * k : DIM * k + k], float(last[-2]), float(last[-1]))]

    return fit(subjects, weights, gradients, steps)


def classify(documents: DataFrame, ident: str, text: str, labels: DataFrame, label_ident: str, label_subject: str, rater: str, subjects: list[str], cutoff: float = CUTOFF, most: int = MOST_LABELLED, steps: int = STEPS) -> DataFrame:
    """(ident, subject, score) for every document and subject whose output reaches ``cutoff``."""
    rows = documents.where(F.col(ident).isNotNull()).select(F.col(ident).alias("_id"), F.col(text).cast("string").alias("_text"))
    reduced = _reduced(rows)
    weights = rarity(reduced)
    model = train(reduced, votes(labels, label_ident, label_subject, rater, subjects), subjects, weights, most, steps=steps) if subjects else None
    kind = reduced.schema["_id"].dataType.simpleString()
    if model is None:
        return reduced.where("false").select(F.col("_id").alias(ident), F.lit("").alias("subject"), F.lit(0.0).alias("score"))
    sent = reduced.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for b in batches:
            own = b.column("_own")
            for start in range(0, len(own), 1000):
                p = sent.value.scores(_unpack(own.slice(start, 1000)), known)
                row, which = np.nonzero(p >= cutoff)
                names = pa.array([sent.value.subjects[k] for k in which], pa.string())
                yield pa.RecordBatch.from_arrays([b.column("_id").slice(start, 1000).take(pa.array(row)), names, pa.array(p[row, which].astype(np.float64))], names=["_id", "subject", "score"])
            if len(known) > 200_000:
                known.clear()

    return reduced.where("_bucket IS NULL").select("_id", "_own").mapInArrow(score, f"_id {kind}, subject string, score double").withColumnRenamed("_id", ident)

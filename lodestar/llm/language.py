"""Language of documents and of their passages: nearest-centroid classification.

Labelled sentences become normalised TF-IDF vectors of character n-grams (2 to 4, hashed to ``DIMENSIONS``); per language they are clustered into
a few unit centroids by spherical k-means. A sentence takes the language of the centroid with the highest cosine; it is rejected (``und``) if that
cosine is below the centroid's radius. The fitted model is a matrix of fixed size and travels to the tasks by broadcast; documents
are read once, whole, without a shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1 << 17
CENTROIDS = 3
MAX_SAMPLES, SAMPLES_A_CENTROID = 20_000, 10
LEAST_WORDS = 8
UNKNOWN = "und"
#: Share of a centroid's lowest training cosine below which a sentence is rejected.
RADIUS = 0.3
#: Least distance to the best other language, as a share of the best cosine, for a sentence to count as evidence.
MARGIN = 0.05
#: Mean lead over the main language that a passage in another one needs to count as present, as a share of the least lead of held-out samples between the two languages.
SHARE = 0.5
FOLDS = 2
ROWS_A_BATCH, TEXTS_A_STEP = 256, 4096

#: Names and codes of the languages, lower case.
SPELLINGS = {
    "en": ("en", "eng", "english"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano"),
    "it": ("it", "ita", "italian", "italiano"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands"),
    "ru": ("ru", "rus", "russian", "русский"),
}

_ENDS = re.compile(r"(?<=[.!?…])[\"'»”)\]]*\s+|[\r\n]+")
_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def normal_label(label: Column) -> Column:
    """Two-letter code of a right spelling of a known language (case, region, three-letter code or name), else null."""
    head = F.split(F.lower(F.trim(label)), "[-_ ]").getItem(0)
    table = F.create_map(*[F.lit(x) for code, names in SPELLINGS.items() for name in names for x in (name, code)])
    return F.try_element_at(table, head)


def label_or_own(label: Column) -> Column:
    """``normal_label``, or the label itself, trimmed and lower-cased, if it names no known language; blank is null."""
    own = F.lower(F.trim(label))
    return F.coalesce(normal_label(label), F.when(own != "", own))


def _unaccented(text: str) -> str:
    """Latin letters without their accents."""
    return "".join(b if (b := unicodedata.normalize("NFD", c)[0]).isascii() else c for c in text)


@lru_cache(maxsize=1)
def _kinds() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each code point is a letter, a letter or digit, white space."""
    every = [chr(i) for i in range(0x110000)]
    return tuple(np.fromiter((f(c) for c in every), bool, len(every)) for f in (str.isalpha, str.isalnum, str.isspace))


@dataclass
class Prepared:
    """Texts as code points: lower-cased letters, everything else one blank, a blank at either end; ``words`` counts the white-space tokens with a letter or digit, ``letters`` the letters of each text."""

    codes: np.ndarray
    rows: np.ndarray
    words: np.ndarray
    letters: np.ndarray

    def only(self, chosen: np.ndarray) -> Prepared:
        """The texts ``chosen`` (ascending positions), renumbered."""
        place = np.full(len(self.words), -1, np.int64)
        place[chosen] = np.arange(len(chosen))
        own = place[self.rows]
        return Prepared(self.codes[own >= 0], own[own >= 0], self.words[chosen], self.letters[chosen])


def prepared(texts: list[str]) -> Prepared:
    alpha_of, alnum_of, space_of = _kinds()
    parts = [f" {t.lower()} " for t in texts]
    lengths = np.array([len(p) for p in parts], np.int64)
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    rows = np.repeat(np.arange(len(texts)), lengths)
    alpha = alpha_of[codes]
    token = np.cumsum(space_of[codes])
    at = np.flatnonzero(alnum_of[codes])
    words = np.bincount(rows[at][np.r_[True, token[at][1:] != token[at][:-1]]] if len(at) else at, minlength=len(texts))
    keep = alpha.copy()
    keep[1:] |= alpha[:-1]  # of what is no letter only the first after a letter stays
    keep[np.cumsum(lengths) - lengths] = True
    return Prepared(np.where(alpha, codes, np.uint32(32))[keep], rows[keep], words, np.bincount(rows[alpha], minlength=len(texts)))


def _features(texts: Prepared) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, dimension, count) of every n-gram of every text, sorted by row; at most ``TEXTS_A_STEP`` texts."""
    codes, rows = texts.codes.astype(np.uint64), texts.rows
    keys, h = [], codes * _MULT[0]
    for n in range(1, 4):
        if len(codes) <= n:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * _MULT[n] + codes[n:] * _MULT[0]
        same = rows[n:] == rows[:-n]
        dims = ((h ^ (h >> np.uint64(32))) >> np.uint64(7)).astype(np.uint32) & np.uint32(DIMENSIONS - 1)
        keys.append((rows[n:][same].astype(np.uint32) << np.uint32(17)) | dims[same])
    if not keys:
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    found = np.sort(np.concatenate(keys))
    first = np.flatnonzero(np.r_[True, found[1:] != found[:-1]]) if len(found) else np.empty(0, np.int64)
    return (found[first] >> np.uint32(17)).astype(np.int64), (found[first] & np.uint32(DIMENSIONS - 1)).astype(np.int64), np.diff(np.r_[first, len(found)])


def _starts(rows: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.empty(0, np.int64)


@dataclass
class Centroids:
    """``columns`` (k x seen n-grams) of the unit centroids, ``place`` of each dimension among the seen ones (-1: in no sample), idf, the centroids' languages and radii;
    by the sorted languages: ``leads``, the least lead of held-out samples of one over another, and ``typical``, the mean cosine of held-out samples."""

    columns: np.ndarray
    place: np.ndarray
    idf: np.ndarray
    langs: list[str]
    radii: np.ndarray
    leads: np.ndarray
    typical: np.ndarray

    @property
    def names(self) -> list[str]:
        return sorted(set(self.langs))

    def scores(self, texts: Prepared) -> np.ndarray:
        """Cosine of every text with every centroid."""
        out = np.zeros((len(texts.words), len(self.langs)), np.float32)
        if not self.langs:
            return out
        rows, dims, counts = _features(texts)
        if not len(rows):
            return out
        w = ((1 + np.log(counts.astype(np.float32))) * self.idf[dims]).astype(np.float32)
        starts = _starts(rows)
        norm = np.zeros(len(out), np.float32)
        norm[rows[starts]] = np.sqrt(np.add.reduceat(w * w, starts))
        at = self.place[dims]
        seen = np.flatnonzero(at >= 0)
        at, w, rows = at[seen], w[seen], rows[seen]
        starts = _starts(rows)
        if len(starts):
            for j, column in enumerate(self.columns):
                out[rows[starts], j] = np.add.reduceat(column[at] * w, starts)
        return out / np.maximum(norm, 1e-9)[:, None]

    def by_language(self, s: np.ndarray) -> np.ndarray:
        """Best cosine of every text with each of the sorted languages."""
        names = self.names
        where = np.array([names.index(x) for x in self.langs])
        return np.stack([np.where(where == i, s, -1).max(1) for i in range(len(names))], 1)

    def best(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language or ``und``, confidence 0..1, margin to the next language) per text."""
        return self.judged(prepared(texts))[:3]

    def judged(self, texts: Prepared) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """``best`` and the lead over every language beyond what a passage needs.

        The confidence is the margin, less where the text is farther from its centroid than held-out samples are.
        """
        n = len(texts.words)
        if not self.langs or not n:
            return [UNKNOWN] * n, np.zeros(n), np.zeros(n), np.zeros((n, len(self.names)))
        s = self.scores(texts)
        names, by = self.names, self.by_language(s)
        order = np.argsort(-by, axis=1, kind="stable")
        top = by[np.arange(len(s)), order[:, 0]]
        second = by[np.arange(len(s)), order[:, 1]] if len(names) > 1 else np.zeros(len(s))
        near = s.argmax(1)
        margin = np.where(top > 0, (top - np.maximum(second, 0)) / np.maximum(top, 1e-9), 0)
        rejected = top < self.radii[near]
        lang = [UNKNOWN if r else names[o] for r, o in zip(rejected, order[:, 0])]
        lead = (top[:, None] - np.maximum(by, 0)) / np.maximum(top, 1e-9)[:, None]
        near_enough = np.minimum(1, np.maximum(top, 0) / np.maximum(self.typical[order[:, 0]], 1e-9))
        return lang, np.where(rejected, 0, np.clip(margin, 0, 1) * near_enough), margin, lead - SHARE * self.leads[order[:, 0]]


def fit(samples: DataFrame, centroids: int = CENTROIDS, max_samples: int = MAX_SAMPLES) -> Centroids:
    """Fit on the ``max_samples`` samples with the smallest ids (a bounded sample by design). Null or unusable samples are left out; none at all rejects everything.

    A language without an entry in ``SPELLINGS`` is kept under its own label, trimmed and lower-cased.
    """
    rows = samples.select("sample_id", label_or_own(F.col("lang")).alias("lang"), "text").orderBy("sample_id").limit(max_samples).collect()
    rows = [(r.lang, r.text) for r in rows if r.lang and r.text and any(c.isalpha() for c in r.text)]
    rows.sort(key=lambda r: r[0])  # every fold gets its part of each language
    model = _fitted(rows, centroids)
    for fold in range(FOLDS if rows else 0):
        held = _with_unaccented(rows[fold::FOLDS])
        other = _fitted([x for i, x in enumerate(rows) if i % FOLDS != fold], centroids)
        if other.names != model.names:
            model.leads[:] = 0  # too few samples to hold any out
            model.typical[:] = 0
            break
        by = np.maximum(other.by_language(_in_steps(other.scores, [t for _, t in held])), 0)
        own = np.array([model.names.index(name) for name, _ in held])
        best = by[np.arange(len(held)), own]
        lead = 1 - by / np.maximum(best, 1e-9)[:, None]
        for i in set(own):
            model.leads[i] = np.minimum(model.leads[i], lead[own == i].min(0))
            model.typical[i] += best[own == i].mean() / FOLDS
    model.leads = np.clip(model.leads, 0, 1)
    return model


def _in_steps(f, texts: list[str]) -> np.ndarray:
    return np.concatenate([f(prepared(texts[a : a + TEXTS_A_STEP])) for a in range(0, len(texts), TEXTS_A_STEP)])


def _with_unaccented(rows: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The samples, and those with accents again without: accents get lost in documents."""
    return rows + [(name, bare) for name, t in rows if (bare := _unaccented(t.lower())) != t.lower()]


def _fitted(rows: list[tuple[str, str]], centroids: int) -> Centroids:
    if not rows:
        return Centroids(np.zeros((0, 0), np.float32), np.full(DIMENSIONS, -1, np.int32), np.ones(DIMENSIONS, np.float32), [], np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    rows = sorted(_with_unaccented(rows), key=lambda r: r[0])
    found = [_features(prepared([t for _, t in rows[a : a + TEXTS_A_STEP]])) for a in range(0, len(rows), TEXTS_A_STEP)]
    r = np.concatenate([f[0] + i * TEXTS_A_STEP for i, f in enumerate(found)])
    d, c = (np.concatenate([f[i] for f in found]) for i in (1, 2))
    idf = np.log((1 + len(rows)) / (1 + np.bincount(d, minlength=DIMENSIONS))) + 1
    dims, at = np.unique(d, return_inverse=True)
    w = (1 + np.log(c)) * idf[d]
    starts = _starts(r)
    w /= np.repeat(np.sqrt(np.add.reduceat(w * w, starts)), np.diff(np.r_[starts, len(r)]))
    langs, columns, radii = [], [], []
    names = np.array([name for name, _ in rows])
    for lang in sorted(set(names)):
        lo, hi = np.searchsorted(r, np.flatnonzero(names == lang)[[0, -1]] + [0, 1])  # the samples of a language are neighbours
        row, col, val = r[lo:hi] - r[lo], at[lo:hi], w[lo:hi]
        n, begin = int(row[-1]) + 1, _starts(row)

        def cosines(centre: np.ndarray) -> np.ndarray:
            return np.add.reduceat(centre[col] * val, begin)

        def dense(i: int) -> np.ndarray:
            own = row == i
            return np.bincount(col[own], val[own], minlength=len(dims))

        k = min(centroids, max(1, n // SAMPLES_A_CENTROID))
        cents = [dense(0)]
        near = cosines(cents[0])[:, None]
        while len(cents) < k:  # farthest first
            cents.append(dense(int(near.max(1).argmin())))
            near = np.c_[near, cosines(cents[-1])]
        for _ in range(10):
            member = near.argmax(1)
            sums = [np.bincount(col[m], val[m], minlength=len(dims)) if (m := member[row] == j).any() else cents[j] for j in range(k)]
            cents = [x / np.linalg.norm(x) for x in sums]
            near = np.stack([cosines(x) for x in cents], 1)
        member = near.argmax(1)
        for j in range(k):
            langs.append(str(lang))
            columns.append(cents[j])
            radii.append(RADIUS * (near[member == j, j].min() if (member == j).any() else 0.0))
    place = np.full(DIMENSIONS, -1, np.int32)
    place[dims] = np.arange(len(dims))
    n = len(set(langs))
    return Centroids(np.stack(columns).astype(np.float32), place, idf.astype(np.float32), langs, np.array(radii), np.ones((n, n)), np.zeros(n))


def _sentences(text: str) -> list[tuple[int, int]]:
    spans, at = [], 0
    for m in _ENDS.finditer(text):
        if m.start() > at:
            spans.append((at, m.start()))
        at = m.end()
    if at < len(text):
        spans.append((at, len(text)))
    return spans


def _segments(text: str, spans: list, langs: dict, conf: dict, margin: dict, words: dict, lead: dict) -> list[dict]:
    """Neighbouring sentences of one language merged; a sentence without evidence of its own joins the passage it stands in."""
    out: list[dict] = []
    for i, (a, b) in enumerate(spans):
        sure = i in langs and langs[i] != UNKNOWN and margin[i] >= MARGIN
        if sure and (not out or out[-1]["lang"] not in (langs[i], None)):
            out.append({"start": a, "stop": b, "lang": langs[i], "conf": conf[i] * words[i], "lead": lead[i] * words[i], "words": words[i], "sentences": 1})
            continue
        if not out:
            out.append({"start": a, "stop": b, "lang": None, "conf": 0.0, "lead": 0.0, "words": 0, "sentences": 0})
        s = out[-1]
        s["stop"] = b
        if sure:
            s["lang"] = langs[i]
            s["conf"] += conf[i] * words[i]
            s["lead"] = s["lead"] + lead[i] * words[i]
            s["words"] += words[i]
            s["sentences"] += 1
    return out


SEGMENTS = "segments array<struct<start:int,stop:int,lang:string,confidence:double,words:int,sentences:int,lead:double>>"


def classify(documents: DataFrame, samples: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, lang_label, lang, confidence, segments) of every document.

    Evidence is a sentence of at least ``LEAST_WORDS`` words that is nearer to one language than to any other by ``MARGIN``; ``lang`` is the language with most words in such
    sentences (ties: alphabetical). ``sentences`` of a segment counts them, ``lead`` is their mean lead over ``lang`` beyond what a passage needs (0 for ``lang`` itself). If no sentence is sure, those of at least ``LEAST_WORDS`` words are judged together;
    a text without such a sentence is classified as a whole (one segment, 0 sentences).
    Null texts, texts without letters and rejected ones give ``und``, confidence 0, no segments.
    ``start``/``stop`` are character offsets.
    """
    model = documents.sparkSession.sparkContext.broadcast(fit(samples))
    kind = documents.schema[id_column].dataType
    types = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("words", pa.int32()), ("sentences", pa.int32()), ("lead", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_A_BATCH):
                batch = whole.slice(at, ROWS_A_BATCH)
                yield _classified(m, batch, id_column, types)

    return documents.select(id_column, F.col("lang").alias("lang_label"), "text").mapInArrow(
        run, f"`{id_column}` {kind.simpleString()}, lang_label string, lang string, confidence double, {SEGMENTS}"
    )


def _classified(m: Centroids, batch: pa.RecordBatch, id_column: str, types: pa.DataType) -> pa.RecordBatch:
    texts = batch.column(2).to_pylist()
    spans_of = [_sentences(text) if text else [] for text in texts]
    whose = [(d, i) for d, spans in enumerate(spans_of) for i in range(len(spans))]
    sentences = prepared([texts[d][slice(*spans_of[d][i])] for d, i in whose])
    words_of: list[dict[int, int]] = [{} for _ in texts]
    all_words = np.zeros(len(texts), np.int64)
    for (d, i), n in zip(whose, sentences.words.tolist()):
        all_words[d] += n
        if n >= LEAST_WORDS:
            words_of[d][i] = n
    lang: list[dict] = [{} for _ in texts]
    conf: list[dict] = [{} for _ in texts]
    margin: list[dict] = [{} for _ in texts]
    lead: list[dict] = [{} for _ in texts]

    def judge(jobs: list[tuple[int, int]], of: Prepared, chosen: np.ndarray) -> None:
        """``jobs`` (document, sentence; -1: the whole text, -2: its sentences together) of the texts ``chosen``."""
        for a in range(0, len(jobs), TEXTS_A_STEP):
            for (d, i), name, c, g, over in zip(jobs[a : a + TEXTS_A_STEP], *m.judged(of.only(chosen[a : a + TEXTS_A_STEP]))):
                lang[d][i], conf[d][i], margin[d][i], lead[d][i] = name, float(c), float(g), over

    long = np.flatnonzero((sentences.words >= LEAST_WORDS) & (sentences.letters > 0))
    judge([whose[x] for x in long], sentences, long)
    whole = [d for d, text in enumerate(texts) if text and not lang[d]]
    if whole:
        of = prepared([texts[d] for d in whole])
        chosen = np.flatnonzero(of.letters > 0)
        judge([(whole[x], -1) for x in chosen], of, chosen)
    # no sentence of a text is sure by itself: its sentences are judged together
    unsure = [d for d in range(len(texts)) if lang[d] and -1 not in lang[d] and not any(n != UNKNOWN and margin[d][i] >= MARGIN for i, n in lang[d].items())]
    if unsure:
        judge([(d, -2) for d in unsure], prepared([" ".join(texts[d][a:b] for i, (a, b) in enumerate(spans_of[d]) if i in lang[d]) for d in unsure]), np.arange(len(unsure)))
    out_lang, out_conf, out_segments = [], [], []
    for d, text in enumerate(texts):
        together = -1 if -1 in lang[d] else -2
        if together in lang[d]:
            name, c = lang[d][together], conf[d][together]
            n = len(words_of[d]) if together == -2 else 0
            segs = [] if name == UNKNOWN else [{"start": 0, "stop": len(text), "lang": name, "confidence": c, "words": int(all_words[d]), "sentences": n, "lead": 0.0}]
        else:
            segs = [s for s in _segments(text or "", spans_of[d], lang[d], conf[d], margin[d], words_of[d], lead[d]) if s["lang"]]
            segs = [{**s, "confidence": s.pop("conf") / s["words"]} for s in segs]
            total: dict[str, list[float]] = {}
            for s in segs:
                t = total.setdefault(s["lang"], [0, 0.0])
                t[0] += s["words"]
                t[1] += s["words"] * s["confidence"]
            name = min(total, key=lambda x: (-total[x][0], x)) if total else UNKNOWN
            c = total[name][1] / total[name][0] if total else 0.0
            segs = [{**s, "lead": 0.0 if s["lang"] == name else float(s["lead"][m.names.index(name)] / s["words"])} for s in segs]
        out_lang.append(name)
        out_conf.append(c)
        out_segments.append(segs)
    return pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(1), pa.array(out_lang, pa.string()), pa.array(out_conf, pa.float64()), pa.array(out_segments, types)],
        names=[id_column, "lang_label", "lang", "confidence", "segments"],
    )


def label_faults(classified: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, lang): every language present in a document whose label is missing, is not its main language, or whose text is in several."""
    present = F.array_distinct(F.transform(F.filter("segments", lambda s: (s["sentences"] > 0) & ((s["lang"] == F.col("lang")) | (s["lead"] >= 0))), lambda s: s["lang"]))
    with_langs = classified.withColumn("_present", present).withColumn("_label", label_or_own(F.col("lang_label")))
    faulty = F.col("_label").isNull() | (F.col("_label") != F.col("lang")) | (F.size("_present") > 1)
    return with_langs.filter(faulty).select(id_column, F.explode("_present").alias("lang"))


def passages(classified: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row per passage in a language: id, start, stop, lang, confidence, words."""
    s = classified.select(id_column, F.explode("segments").alias("s"))
    return s.select(id_column, "s.start", "s.stop", "s.lang", "s.confidence", "s.words")

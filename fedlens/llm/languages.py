"""Missing, wrong or mixed language labels: a language with a confidence for every text and part of a text.

Model: for each language a probability per piece of a fixed public vocabulary. The probability of a word is
the sum over all ways to cut it into pieces (forward algorithm, no best segmentation is chosen); that of a
sentence is the product over its words. Pieces are estimated by expectation-maximisation over the same sums,
from at most `PIECES` sentences of labelled texts (documented bounds: texts by a hash of their id, `SAMPLE` of
them expected; sentences by a hash of id and place, whatever the length of their text; one of more than
`PIECE_WORDS` words counts as several). Since labels may be wrong, sentences the first models assign to another
language move there before the models are estimated anew.

Confidence: the posterior of the part's language, with log probabilities divided by t n^b for n words; t and b
are those under which the labels of held-out sentences (one of `HELD_OUT`) are most likely, a share of wrong
labels being allowed for. Words of a text aren't independent, and without this every part would look certain.

A text is cut after sentence ends and at line or column breaks. Words that hold digits, the units behind
numbers and codes have no language, nor has a word in which a text of several words breaks off. Between sentences a change of language costs `SWITCH` nats, so a cut-off
or empty sentence follows its neighbours; runs of sentences in one language are the text's parts.

Scale: one pass over the texts without any shuffle; the model is a few MB whatever the data. Words repeat, so
each task scores a word once and keeps it in a bounded table.

Defined results: text that is null or without any letter has no parts and no language; case, accents and
blanks don't matter; an unknown or meaningless label counts as missing.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE, PIECES, PIECE_WORDS, HELD_OUT = 20_000, 100_000, 50, 10
TOKENIZERS = "/opt/tokenizers"
SWITCH, FLOOR, KEPT_WORDS, SPACE = 4.0, 1e-7, 200_000, "▁"
SENTENCE = re.compile(r"(?<=[.!?…。！？])[\"'»”)\]]*\s+|\s*[\n\r|]+\s*")
WORDLESS = re.compile(r"\S*\d\S*(?:\s+(?:[%°µ]\S{0,3}|[A-Za-zµ]{1,2}\b(?!['’])))?")
WORD = re.compile(r"[^\W\d_]+")


def simple(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def sentences(text: str) -> list[str]:
    return [s for s in SENTENCE.split(text.strip()) if s and s.strip()]


def words(sentence: str) -> list[str]:
    return WORD.findall(WORDLESS.sub(" ", simple(sentence)))


def vocabulary(tokenizers: str = TOKENIZERS) -> list[str]:
    """The pieces of the public vocabulary in the form texts are scored in."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=f"{tokenizers}/piece_bpe_32k.model")
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)))
    return sorted({simple(p) for p in pieces} - {""})


def unbroken(text: str, found: list[list[str]]) -> list[list[str]]:
    """The words of each sentence of a text, without the last one if the text breaks off in it and there are others."""
    if found and found[-1] and sum(map(len, found)) > 1 and simple(text.rstrip()).endswith(found[-1][-1]):
        return [*found[:-1], found[-1][:-1]]
    return found


class Pieces:
    """Log probabilities (pieces, languages) and the forward sums over them."""

    def __init__(self, names: list[str], log_p: np.ndarray):
        self.names, self.log_p = names, log_p
        self.at = {p: i for i, p in enumerate(names)}
        self.longest = max(map(len, names), default=1)
        self.kept: dict[str, int] = {}
        self.rows = np.zeros((0, log_p.shape[1]))

    def cuts(self, word: str) -> list[list[tuple[int, int]]]:
        """For each end position the (start, piece) of the pieces that end there; an unknown letter is piece -1."""
        s = SPACE + word
        out: list[list[tuple[int, int]]] = [[]]
        for j in range(1, len(s) + 1):
            here = [(i, self.at[s[i:j]]) for i in range(max(0, j - self.longest), j) if s[i:j] in self.at]
            out.append(here if any(i == j - 1 for i, _ in here) else [*here, (j - 1, -1)])
        return out

    def forward(self, word: str, cuts: list | None = None) -> np.ndarray:
        """(positions + 1, languages): log of the sum over all segmentations of each prefix."""
        cuts = cuts or self.cuts(word)
        alpha = np.zeros((len(cuts), self.log_p.shape[1]))
        for j in range(1, len(cuts)):
            starts, pieces = zip(*cuts[j], strict=True)
            terms = alpha[list(starts)] + self.log_p[list(pieces)]  # the last row is that of unknown letters
            top = terms.max(0)
            alpha[j] = top + np.log(np.exp(terms - top).sum(0))
        return alpha

    def expected(self, word: str) -> dict[int, np.ndarray]:
        """Expected uses of each piece per language over all segmentations of a word."""
        cuts = self.cuts(word)
        alpha = self.forward(word, cuts)
        n = len(cuts) - 1
        beta = np.full_like(alpha, -np.inf)
        beta[n] = 0
        uses: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(self.log_p.shape[1]))
        for j in range(n, 0, -1):
            for i, p in cuts[j]:
                step = self.log_p[p] + beta[j]
                beta[i] = np.logaddexp(beta[i], step)
                uses[p] += np.exp(alpha[i] + step - alpha[n])
        return uses

    def scores(self, found: list[str]) -> np.ndarray:
        """(words, languages), each word's sum computed once."""
        if len(self.kept) > KEPT_WORDS:
            self.kept, self.rows = {}, self.rows[:0]
        new = [w for w in dict.fromkeys(found) if w not in self.kept]
        if new:
            base = len(self.kept)
            self.kept.update((w, base + k) for k, w in enumerate(new))
            self.rows = np.concatenate([self.rows, np.stack([self.forward(w)[-1] for w in new])])
        return self.rows[[self.kept[w] for w in found]] if found else np.zeros((0, self.log_p.shape[1]))


def estimate(counts: list[Counter], names: list[str], rounds: int = 4) -> Pieces:
    """Piece probabilities of each language from its word counts, by expectation-maximisation."""
    model = Pieces(names, np.full((len(names) + 1, len(counts)), -np.log(len(names) + 1)))
    every = sorted(set().union(*counts))
    weight = np.array([[c[w] for c in counts] for w in every], dtype=float).reshape(len(every), len(counts))
    for _ in range(rounds):
        uses = np.zeros((len(names) + 1, len(counts)))
        for w, n in zip(every, weight, strict=True):
            for p, u in model.expected(w).items():
                uses[p] += u * n
        total = uses.sum(0) + 1e-9
        model = Pieces(names, np.log(uses / total * (1 - FLOOR * len(uses)) + FLOOR))
    return model


def train(texts: list[tuple[str, int]], languages: int, names: list[str], passes: int = 2) -> Pieces:
    """Models from (text, language number) with some wrong numbers: sentences move to the language that explains them."""
    parts = [(words(s), lang) for text, lang in texts for s in sentences(text)]
    parts = [(w, lang) for w, lang in parts if w]
    seen = {c for w, _ in parts for c in "".join(w)} | {SPACE}
    names = [p for p in names if set(p) <= seen]
    for step in range(passes + 1):
        counts = [Counter() for _ in range(languages)]
        for found, lang in parts:
            counts[lang].update(found)
        model = estimate(counts, names, 2 if step < passes else 4)
        if step < passes:
            owner = [int(model.scores(w).sum(0).argmax()) for w, _ in parts]
            parts = [(w, best) for (w, _), best in zip(parts, owner, strict=True)]
    return model


def runs(score: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each sentence when each change costs `switch`."""
    n, k = score.shape
    total, back = score[0].copy(), np.zeros((n, k), dtype=int)
    for t in range(1, n):
        best = int(total.argmax())
        stay = total >= total[best] - switch
        back[t] = np.where(stay, np.arange(k), best)
        total = np.where(stay, total, total[best] - switch) + score[t]
    path = np.empty(n, dtype=int)
    path[-1] = int(total.argmax())
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t][path[t]]
    return path


def softmax(score: np.ndarray) -> np.ndarray:
    e = np.exp(score - score.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def calibrated(score: np.ndarray, words_in: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(t, b) of the module's confidence from scores (texts, languages), word counts and labels; (1, 0) without any."""
    best, found = -np.inf, (1.0, 0.0)
    if not len(score):
        return found
    own = np.arange(len(score))
    for t in 2.0 ** np.arange(0, 5.5, 0.5):
        for b in (0.0, 0.25, 0.5, 0.75, 1.0):
            p = softmax(score / (t * words_in[:, None] ** b))[own, labels]
            for wrong in (0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3):
                fit = np.log((1 - wrong) * p + wrong / score.shape[1]).sum()
                if fit > best:
                    best, found = fit, (float(t), float(b))
    return found


def certainties(score: np.ndarray, lang: np.ndarray, words_in: np.ndarray, scale: tuple[float, float]) -> np.ndarray:
    """Calibrated posteriors of the languages `lang` of parts with these scores (parts, languages) and word counts, all languages equally likely before."""
    return softmax(score / (scale[0] * np.maximum(1, words_in)[:, None] ** scale[1]))[np.arange(len(score)), lang]


def label_forms(languages: DataFrame) -> dict[str, str]:
    """Code by every written form of a label; languages is a table of one row per language."""
    out = {}
    for r in languages.select("lang", "iso3", "english_name").collect():
        out.update({str(f).strip().lower(): r["lang"] for f in (r["lang"], r["iso3"], r["english_name"]) if f})
    return out


def labelled(label: str | None, forms: dict[str, str]) -> str | None:
    """The code a label names: a code, three-letter code or name in any case, blanks around it, with or without region."""
    plain = (label or "").strip().lower()
    return forms.get(plain) or forms.get(re.split(r"[-_ (]", plain)[0]) if plain else None


def pieces_of(text: str) -> list[str]:
    """The sentences of a text, those of more than `PIECE_WORDS` words cut."""
    out = []
    for sentence in sentences(text):
        found = sentence.split()
        out += [sentence] if len(found) <= PIECE_WORDS else [" ".join(found[i : i + PIECE_WORDS]) for i in range(0, len(found), PIECE_WORDS)]
    return out


def sampled(docs: DataFrame, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE, pieces: int = PIECES) -> DataFrame:
    """(i, no, t, l): at most `pieces` sentences with the label of their text."""
    c = lambda n: docs[f"`{n}`"]
    rows = docs.select(c(id_col).cast("long").alias("i"), c(text_col).cast("string").alias("t"), c(label_col).cast("string").alias("l")).filter("i is not null and t is not null and l is not null")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text, label in zip(*[b.column(n).to_pylist() for n in ("i", "t", "l")], strict=True):
                found = pieces_of(text)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(found)), pa.array(range(len(found)), pa.int32()), pa.array(found), pa.array([label] * len(found))], ["i", "no", "t", "l"])

    total = docs.count()
    if total > sample:
        rows = rows.filter(F.shiftrightunsigned(F.xxhash64("i"), 11) < F.lit(int(sample / total * (1 << 53))))
    return rows.mapInArrow(cut, "i long, no int, t string, l string").orderBy(F.xxhash64("i", "no"), "i", "no", "t", "l").limit(pieces)


def fit(docs: DataFrame, forms: dict[str, str], id_col: str, text_col: str, label_col: str, sample: int = SAMPLE, tokenizers: str = TOKENIZERS) -> tuple[Pieces, list[str], tuple[float, float]]:
    """The model, the languages' codes, and the scale of confidences."""
    codes = sorted(set(forms.values()))
    taken = sampled(docs, id_col, text_col, label_col, sample).collect()  # at most PIECES short rows
    texts = [(r["t"], codes.index(code)) for r in taken if (code := labelled(r["l"], forms))]
    held = [(w, lang) for text, lang in texts[::HELD_OUT] if (w := words(text))]
    model = train([x for k, x in enumerate(texts) if k % HELD_OUT or len(texts) < HELD_OUT], len(codes), vocabulary(tokenizers))
    score = np.stack([model.scores(w).sum(0) for w, _ in held]) if held else np.zeros((0, len(codes)))
    return model, codes, calibrated(score, np.array([len(w) for w, _ in held]), np.array([lang for _, lang in held]))


SCHEMA = "id long, label string, seg_no int, parts int, lang string, confidence double, sentences int, first_sentence int, characters long"
FIELDS = pa.schema([("id", pa.int64()), ("label", pa.string()), ("seg_no", pa.int32()), ("parts", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("sentences", pa.int32()), ("first_sentence", pa.int32()), ("characters", pa.int64())])


def segments(docs: DataFrame, languages: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(id, label, seg_no, parts, lang, confidence, sentences, first_sentence, characters): every part of every text; label is the code its label names, parts the number of the text's parts."""
    forms = label_forms(languages)
    model, codes, scale = fit(docs, forms, id_col, text_col, label_col, sample, tokenizers)
    shared = docs.sparkSession.sparkContext.broadcast((model.names, model.log_p, codes, forms, scale))  # bounded by vocabulary and languages
    c = lambda n: docs[f"`{n}`"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, log_p, codes, forms, scale = shared.value
        pieces = Pieces(names, log_p)
        for b in batches:
            cut = [sentences(t) if t else [] for t in b.column("t").to_pylist()]
            found = [w for t, doc in zip(b.column("t").to_pylist(), cut, strict=True) if doc for w in unbroken(t, [words(s) for s in doc])]
            per_word = pieces.scores([w for s in found for w in s])
            ends = np.cumsum([len(s) for s in found]) if found else np.zeros(0, dtype=int)
            sums = np.concatenate([np.zeros((1, len(codes))), np.cumsum(per_word, axis=0)])
            score = sums[ends] - sums[np.concatenate([[0], ends[:-1]]).astype(int)] if len(ends) else np.zeros((0, len(codes)))
            rows, part_scores, part_words, at = [], [], [], 0
            for i, label, doc in zip(b.column("i").to_pylist(), b.column("l").to_pylist(), cut, strict=True):
                own = score[at : at + len(doc)]
                counts = [len(found[at + k]) for k in range(len(doc))]
                at += len(doc)
                if not any(counts):
                    continue
                path = runs(own)
                starts = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1), len(doc)]
                code = labelled(label, forms)
                for k, (lo, hi) in enumerate(zip(starts, starts[1:], strict=False)):
                    lang = int(path[lo])
                    part_scores.append(own[lo:hi].sum(0))
                    part_words.append(sum(counts[lo:hi]))
                    rows.append((i, code, k + 1, len(starts) - 1, lang, hi - lo, int(lo) + 1, sum(map(len, doc[lo:hi]))))
            if not rows:
                yield pa.RecordBatch.from_arrays([pa.array([], t) for t in FIELDS.types], schema=FIELDS)
                continue
            *head, langs, held, first, size = zip(*rows, strict=True)
            sure = certainties(np.stack(part_scores), np.array(langs), np.array(part_words), scale)
            columns = [*head, [codes[x] for x in langs], sure, held, first, size]
            yield pa.RecordBatch.from_arrays([pa.array(x if isinstance(x, np.ndarray) else list(x), t) for x, t in zip(columns, FIELDS.types, strict=True)], schema=FIELDS)

    return docs.select(c(id_col).cast("long").alias("i"), c(text_col).cast("string").alias("t"), c(label_col).cast("string").alias("l")).mapInArrow(run, SCHEMA)


def mislabelled(parts: DataFrame) -> DataFrame:
    """The parts of texts whose label is missing or wrong, or that hold several languages."""
    return parts.filter("parts > 1 or label is null or label <> lang")

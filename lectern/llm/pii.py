"""Personal information in free text, found by a skip-chain conditional random field.

Tokens are words, numbers, single Chinese characters, signs and line ends. The
field has a label for the first and the further tokens of each kind, weights for
a token's word, form and shape and those of its neighbours, for what stands
before and after its run, and for neighbouring labels. Within a document, words
that read the same or almost the same (one letter more, less or other), names of
two letters and pairs of Chinese characters among them, are linked to their next
occurrence; these skip edges favour equal kinds. Beliefs are passed along the
chain and over the skip edges in turns (loopy belief propagation), and the best
label sequence under the last messages is read off. Items consist of name-like
tokens (rare words in a letter case that names have in the document, initials,
particles), tokens within a shape, and those NEAR them, so the chain runs over
these; all others are no item.

The weights are fitted on a bounded sample: the SAMPLE_DOCS documents of lowest
hash that have at most SAMPLE_CHARS characters. Cues label part of it; runs that
no cue is beside are open, and the likelihood of what is labelled is summed over
all their labels. A second fit takes the first one's labels for them. Null and
empty texts have no items; an untrained field (an empty table) finds none.
Positions are in code points; items of one text don't overlap.
"""

from __future__ import annotations

import io
import json
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.consolidate import open_fs
from ..session import uncollected
from .pii_rules import KINDS, LISTED, NAME_CUED, TITLES, cited, in_shapes, name_cue, shape_spans

#: Kinds that have forms of their own.
SHAPES = KINDS[:4]
#: Bound of the training sample (documents, characters each), and of words kept.
SAMPLE_DOCS, SAMPLE_CHARS, MAX_WORDS = 4000, 6000, 20_000
#: Occurrences that make a word common, passes over the sample for the three fits,
#: share of its chains without items that are used, rounds of messages, step and
#: shrinking of the fit, weight of the skip edges, tokens beside a candidate.
COMMON, PASSES, SPARE, ROUNDS, STEP, SHRINK, SKIP, NEAR = 6, (10, 14, 24), 1.0, 3, 0.25, 2e-5, 0.4, 2
#: Tokens of a batch of the fit.
BATCH = 2000
#: Shares of words and of endings that the fit takes for unknown.
BLUR = 0.15, 0.4
LABELS = ["O", *[f"{p}-{k}" for k in KINDS for p in "BI"]]
N_LABELS = len(LABELS)
KIND_OF = np.array([0, *[i + 1 for i in range(len(KINDS)) for _ in "BI"]])
NAME_LABELS = [i for i, x in enumerate(LABELS) if x == "O" or x.endswith("-name")]
TOKEN = re.compile(r"[一-鿿]|[^\W\d_一-鿿](?:[^\W\d_一-鿿]|[\u0300-\u036f])*|\d+|[^\w\s]|_|\n\s*")
_HAN = re.compile(r"[一-鿿]")
_PARTICLES = {"van", "der", "de", "la", "von", "del", "den", "di", "da", "dos", "du", "le", "al", "bin", "ben", "zu"}
#: The most frequent Chinese family names that are hardly ever other words.
_FAMILY = set("王李张刘陈杨黄赵吴周徐孙马朱胡郭何林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范廖贾夏韦付邹孟熊秦邱尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵钱严覃武戴莫孔汤")
#: Characters of particles and verbs that end a Chinese name.
_NO_NAME = set("的是在和与说了于为请把被对向从到住将也都先女医教老同")
#: Templates of a token's evidence: (channel, offset). Channels: word, form, shape.
TEMPLATES = [*[(0, o) for o in (-3, -2, -1, 0, 1, 2, 3)], *[(1, o) for o in (-2, -1, 0, 1, 2)], *[(2, o) for o in (-1, 0, 1)]]
N_CONTEXT = 5
#: Evidence of the first fit: what a token itself is like, not what stands
#: around it, since cues label by that and would teach the field nothing else.
OWN = [channel == 2 or offset == 0 for channel, offset in TEMPLATES] + [False] * N_CONTEXT
EVERY = [True] * len(OWN)
NONE, LINE, ALPHA, LOWER, UPPER, INITIAL, PARTICLE, RARE, SIGN, HAN, FAMILY, STOP, COMMA, END, APOSTROPHE, HYPHEN, CODE = 0, 1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768


@lru_cache(maxsize=200_000)
def fold(word: str) -> str:
    flat = unicodedata.normalize("NFKD", word)
    return "".join(c for c in flat if not unicodedata.combining(c)).casefold()


@lru_cache(maxsize=200_000)
def form(word: str) -> str:
    """Letter case or digits of a token, its length and ending."""
    if word.isdigit():
        return f"9{min(len(word), 12)}"
    if not word[0].isalpha():
        return word
    if _HAN.match(word):
        return "han family" if word in _FAMILY else "han"
    case = "X" if len(word) == 1 and word.isupper() else "XX" if word.isupper() else "Xx" if word[0].isupper() else "xx" if word.islower() else "xX"
    return case if len(word) == 1 else case + fold(word)[-3:] if len(word) > 4 else f"{case}{len(word)}"


@dataclass
class Coded:
    """Tokens of some texts as numbers, with a blank token before each text, and
    the rows of tokens that may belong to an item."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    channels: list[np.ndarray]
    context: list[np.ndarray]
    flags: np.ndarray
    named: np.ndarray
    open_at: np.ndarray
    tokens: list[str]
    first: np.ndarray
    last: np.ndarray


class Codes(dict):
    """Token -> number of the token; tables by that number have its word, form and flags."""

    def __init__(self, coder: Coder):
        super().__init__()
        self.coder, self.rows, self._tables = coder, [], None

    def __missing__(self, token: str) -> int:
        if len(self.rows) > 400_000:
            self.clear()
            self.rows, self._tables = [], None
        self[token] = n = len(self.rows)
        self.rows.append(self.coder.code(token))
        return n

    def tables(self) -> np.ndarray:
        if self._tables is None or len(self._tables) < len(self.rows):
            self._tables = np.array(self.rows, dtype=np.int64).reshape(-1, 3)
        return self._tables


@dataclass
class Coder:
    """Numbers of words and forms; what isn't known is a rare word of its form's class."""

    words: dict[str, int]
    forms: dict[str, int]

    #: Of shapes: kind and place in it; of name-like runs: words (none to three or more), initials (to two), first or further token.
    RUNS = 1 + 4 * len(SHAPES)
    SHAPE_IDS = RUNS + 4 * 3 * 2

    def code(self, token: str) -> tuple[int, int, int]:
        """Word number, form number and flags of a token."""
        if token[0] == "\n":
            return self.words["<line>"], self.forms["<pad>"], LINE
        w = self.words.get(fold(token))
        rare = w is None
        if rare:
            w = self.words[f"<{'9' if token.isdigit() else 'han' if _HAN.match(token) else 'a' if token[0].isalpha() else '.'}>"]
        known = form(token)
        f = self.forms.get(known)
        if f is None:
            f = self.forms.get("<" + known[:2] + ">", self.forms["<>"])
        flags = RARE if rare else NONE
        if _HAN.match(token):
            flags |= HAN | (FAMILY if token in _FAMILY else 0)
        elif token[0].isalpha():
            flags |= ALPHA | (UPPER if token.isupper() else 0) | (LOWER if token.islower() else 0)
            if len(token) == 1:
                flags |= INITIAL
            if fold(token) in _PARTICLES:
                flags |= PARTICLE
        elif token in ".-'’,":
            flags |= SIGN | (STOP if token == "." else COMMA if token == "," else 0)
            flags |= APOSTROPHE if token in "'’" else HYPHEN if token == "-" else 0
        if token == "_" or token.isdigit():
            flags |= CODE
        if token in ".!?。！？":
            flags |= END
        return w, f, flags

    def encode(self, texts: list[str], shapes: list[dict] | None = None) -> Coded:
        if not hasattr(self, "_codes"):
            self._codes = Codes(self)
        start, end, tokens, sizes = [], [], [], []
        for text in texts:
            begin = len(tokens)
            tokens.append("\n")
            start.append(0)
            for m in TOKEN.finditer(text):
                start.append(m.start())
                tokens.append(m.group())
            sizes.append(len(tokens) - begin)
        codes = self._codes
        seen = len(codes.rows)
        ids = [codes[t] for t in tokens]
        if len(codes.rows) < seen:  # the table was begun anew in between
            ids = [codes[t] for t in tokens]
        start = np.array(start, dtype=np.int64)
        n = len(tokens)
        end = start + np.fromiter(map(len, tokens), np.int64, n)
        begins = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64) if sizes else np.zeros(0, np.int64)
        end[begins] = 0
        doc = np.repeat(np.arange(len(texts)), sizes)
        table = codes.tables()[ids] if n else np.zeros((0, 3), np.int64)
        word, forms, flags = table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy()
        word[begins] = self.words["<pad>"]
        flags[begins] = LINE  # the blank token ends the text before
        shape = np.zeros(n, dtype=np.int64)
        first, last = np.arange(n), np.arange(n)
        for d, text in enumerate(texts):
            spans = shape_spans(text) if shapes is None else shapes[d]
            begin, stop = begins[d], begins[d] + sizes[d]
            for s, kind in enumerate(SHAPES):
                for a, b in spans[kind]:
                    i, j = begin + 1 + np.searchsorted(start[begin + 1 : stop], a), begin + 1 + np.searchsorted(start[begin + 1 : stop], b)
                    if i < j and not shape[i:j].any():
                        shape[i:j] = 1 + 4 * s + 1
                        shape[i] = 1 + 4 * s
                        if j - i > 1:
                            shape[j - 1] = 1 + 4 * s + 2
                        first[i:j], last[i:j] = i, j - 1
        named = self._named(flags, start, end) & (shape == 0)
        # signs between name-like tokens belong to their run
        joint = np.zeros(n, dtype=bool)
        if n > 2:
            # a full stop only behind an initial, the others where nothing but a comma's blank is beside them
            sign = flags[1:-1]
            tight = (start[1:-1] == end[:-2]) & (start[2:] - end[1:-1] <= (sign & COMMA > 0) + (sign & STOP > 0))
            joint[1:-1] = (sign & SIGN > 0) & named[:-2] & named[2:] & tight & ((sign & STOP == 0) | (flags[:-2] & INITIAL > 0))
        run = named | joint
        idx = np.arange(n)
        begins_run = run & ~np.r_[False, run[:-1]]
        ends_run = run & ~np.r_[run[1:], False]
        if run.any():
            first = np.where(run, np.maximum.accumulate(np.where(begins_run, idx, 0)), first)
            last = np.where(run, np.minimum.accumulate(np.where(ends_run, idx, n)[::-1])[::-1], last)
            number = np.cumsum(begins_run)
            single = (flags & INITIAL > 0) & run
            initials = np.minimum(np.bincount(number[single], minlength=number[-1] + 1), 2)
            words = np.minimum(np.bincount(number[named & ~single & (flags & (HAN | PARTICLE) == 0)], minlength=number[-1] + 1), 3)
            shape[run] = (self.RUNS + (words * 3 + initials)[number] * 2 + ~begins_run)[run]
        context = [word[np.maximum(first - k, 0)] for k in (1, 2, 3)] + [word[np.minimum(last + k, n - 1)] for k in (1, 2)]
        near = shape > 0
        open_at = near.copy()
        for k in range(1, NEAR + 1):
            open_at[k:] |= near[:-k]
            open_at[:-k] |= near[k:]
        open_at[begins] = False
        return Coded(start, end, doc, [word, forms, shape], context, flags, named, open_at, tokens, first, last)

    def _named(self, flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens that may belong to a name: rare words, in a sentence with
        capitals only capitalised ones, initials and particles; Chinese
        characters that are rare or family names, and the two behind those."""
        alpha = flags & ALPHA > 0
        lower, upper = flags & LOWER > 0, flags & UPPER > 0
        n = len(flags)
        # a sentence ends at a stop, a line end or a wider gap; up to its first capital it may be in small letters throughout
        ends = flags & LINE > 0
        gap = np.r_[start[1:] - end[:-1], 0] if n else start
        ends |= (flags & END > 0) & (gap > 0) & ~np.r_[False, (flags & INITIAL > 0)[:-1]][:n] | (gap > 1)
        sentence = np.cumsum(ends) - ends
        capital = alpha & ~lower & ~upper & (flags & INITIAL == 0)
        before = np.cumsum(capital)
        if n:
            first = np.searchsorted(sentence, sentence)
            small = before - np.r_[0, before][first] == 0
            for k in (1, 2):
                small[:-k] &= ~(capital[k:] & (sentence[k:] == sentence[:-k]))
        else:
            small = alpha
        rare = flags & RARE > 0
        named = alpha & (flags & INITIAL == 0) & rare & (~lower | small)
        # initials have a full stop, or stand right before or behind a name
        initial = (flags & INITIAL > 0) & (upper | small)
        if len(named) > 1:
            stop = flags & STOP > 0
            ahead, back = np.r_[named[1:], False], np.r_[False, named[:-1]]
            mark = flags & APOSTROPHE > 0
            initial &= ~np.r_[False, mark[:-1]]
            ahead, back = ahead & upper, back & upper  # a small letter without a stop is a word
            led = np.r_[(mark[1:] & (gap[:-1] == 0))[:], False] & np.r_[named[2:], False, False]  # O'Neill, d'Arc
            named = named | initial & (np.r_[stop[1:], False] | ahead | back) | (flags & INITIAL > 0) & led
            # what touches a number or an underscore is part of a code; what a hyphen joins to a name is part of it
            code = flags & CODE > 0
            named &= ~(np.r_[code[1:] & (gap[:-1] == 0), False] | np.r_[False, code[:-1] & (gap[:-1] == 0)])
            hyphen = (flags & HYPHEN > 0) & np.r_[False, named[:-1]] & np.r_[False, gap[:-1] == 0] & (gap == 0)
            named |= alpha & np.r_[False, hyphen[:-1]]
        particle = flags & PARTICLE > 0
        named |= particle & (np.r_[named[1:], False] | np.r_[np.r_[named[2:], False], False][: len(named)] if len(named) else particle)
        family = flags & FAMILY > 0
        han = flags & HAN > 0
        lead = family | han & rare
        behind = han & (np.r_[False, lead[:-1]] | np.r_[False, False, lead[:-2]][:n]) if n else han
        return named | lead | behind

    @classmethod
    def learn(cls, texts: list[str], named: Counter) -> Coder:
        """named: how often words stand where a cue shows a name."""
        words, forms = Counter(), Counter()
        for text in texts:
            tokens = TOKEN.findall(text)
            words.update({fold(t) for t in tokens if t[0] != "\n"})
            forms.update({form(t) for t in tokens if t[0] != "\n"})
        least = max(2, min(COMMON, len(texts) // 150))
        proper = Counter(fold(w) for t in texts for w in cited(t))
        keep = [w for w, n in words.most_common(MAX_WORDS) if n >= least and proper[w] < max(1, n / 20) and not (w[:1].isalpha() and (len(w) > 2 or _HAN.match(w)) and named[w] >= max(2, n / 10))]
        keep += sorted(TITLES - set(keep))
        special = ["<pad>", "<line>", "<9>", "<han>", "<a>", "<.>"]
        kinds = ["<pad>", "<>", "<xx>", "<Xx>", "<XX>", "<xX>"]
        return cls({w: i for i, w in enumerate(special + keep)}, {f: i for i, f in enumerate(kinds + [f for f, n in forms.most_common(MAX_WORDS) if n >= least])})

    def __getstate__(self):
        return {"words": self.words, "forms": self.forms}

    def __setstate__(self, state):
        self.__dict__.update(state)


@dataclass
class Field:
    coder: Coder
    weights: list[np.ndarray]
    moves: np.ndarray
    skip: np.ndarray

    def evidence(self, c: Coded, rows: np.ndarray) -> np.ndarray:
        """Scores of the labels of some tokens."""
        n = len(c.start)
        out = np.zeros((len(rows), N_LABELS))
        for w, (channel, offset) in zip(self.weights, TEMPLATES):
            out += w[c.channels[channel][np.clip(rows + offset, 0, n - 1)]]
        for w, ids in zip(self.weights[len(TEMPLATES) :], c.context):
            out += w[ids[rows]]
        return out

    def save(self) -> bytes:
        """The field as bytes, to be kept and used again."""
        out = io.BytesIO()
        text = np.frombuffer(json.dumps([list(self.coder.words), list(self.coder.forms)]).encode(), dtype=np.uint8)
        np.savez_compressed(out, coder=text, moves=self.moves, skip=self.skip, **{f"w{i}": w.astype(np.float32) for i, w in enumerate(self.weights)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Field:
        with np.load(io.BytesIO(data)) as z:
            words, forms = json.loads(z["coder"].tobytes().decode())
            coder = Coder({w: i for i, w in enumerate(words)}, {f: i for i, f in enumerate(forms)})
            weights = [z[f"w{i}"].astype(np.float64) for i in range(len(TEMPLATES) + N_CONTEXT)]
            return cls(coder, weights, z["moves"], z["skip"])


def allowed_moves() -> np.ndarray:
    ok = np.zeros((N_LABELS, N_LABELS))
    for j, to in enumerate(LABELS):
        for i, here in enumerate(LABELS):
            if to[0] == "I" and here[1:] != to[1:]:
                ok[i, j] = -np.inf
    return ok


def beliefs(scores: np.ndarray, moves: np.ndarray, with_pairs: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals (batch, length, labels), pair sums (labels, labels) and log sums
    of chains of equal length that begin and end beside an O."""
    b, t, k = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    m = np.exp(moves)
    ahead, back = np.empty_like(e), np.empty_like(e)
    norm = np.empty((b, t, 1))
    a = m[0] * e[:, 0]
    for i in range(t):
        if i:
            a = (ahead[:, i - 1] @ m) * e[:, i]
        norm[:, i] = a.sum(axis=1, keepdims=True) + 1e-300
        ahead[:, i] = a / norm[:, i]
    back[:, -1] = m[:, 0]
    for i in range(t - 2, -1, -1):
        back[:, i] = (e[:, i + 1] * back[:, i + 1]) @ m.T / norm[:, i + 1]
    post = ahead * back
    total = post.sum(axis=2, keepdims=True) + 1e-300
    pairs = np.zeros((k, k))
    if t > 1 and with_pairs:
        right = e[:, 1:] * back[:, 1:] / norm[:, 1:] / total[:, 1:]
        pairs = np.einsum("bti,btj->ij", ahead[:, :-1], right) * m
    return post / total, pairs, np.log(norm).sum(axis=(1, 2)) + np.log((ahead[:, -1] * m[:, 0]).sum(axis=1) + 1e-300)


def best_labels(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    b, t, k = scores.shape
    here = moves[0] + scores[:, 0]
    came = np.zeros((b, t, k), dtype=np.int8)
    for i in range(1, t):
        step = here[:, :, None] + moves
        came[:, i] = step.argmax(axis=1)
        here = step.max(axis=1) + scores[:, i]
    out = np.zeros((b, t), dtype=np.int8)
    out[:, -1] = here.argmax(axis=1)
    for i in range(t - 1, 0, -1):
        out[:, i - 1] = came[np.arange(b), i, out[:, i]]
    return out


def _runs(c: Coded) -> list[tuple[int, int]]:
    """First and last token of each name-like run."""
    at = np.flatnonzero((c.named) & (c.first == np.arange(len(c.first))))
    return [(int(i), int(c.last[i])) for i in at]


def labelled(texts: list[str], c: Coded, shapes: list[dict]) -> tuple[np.ndarray, list[tuple[int, int, str]]]:
    """The label of each token as cues have it, and the token spans (first,
    behind the last, kind) that no cue tells about."""
    gold = np.zeros(len(c.start), dtype=np.int64)
    unsure: list[tuple[int, int, str]] = []
    begins = np.searchsorted(c.doc, np.arange(len(texts) + 1))
    taken = np.zeros(len(c.start), dtype=bool)
    for d, text in enumerate(texts):
        begin, stop = begins[d] + 1, begins[d + 1]
        found, doubt = in_shapes(text, shapes[d])
        spans = [(*x, True) for x in sorted(found, key=lambda x: (x[0], -x[1]))] + [(*x, False) for x in doubt]
        for a, b, kind, sure in spans:
            i, j = begin + np.searchsorted(c.start[begin:stop], a), begin + np.searchsorted(c.start[begin:stop], b)
            if i >= j or sure and taken[i:j].any():
                continue
            if sure:
                gold[i:j] = 2 + 2 * KINDS.index(kind)
                gold[i] -= 1
                taken[i:j] = True
            elif not taken[i:j].any():
                unsure.append((i, j, kind))
    ended, in_doc = -1, -1  # where the last name of the text ends
    for i, j in _runs(c):
        if taken[i : j + 1].any():
            continue
        if c.flags[i] & HAN:  # up to four characters, as far as they may be a name's
            j = i
            while j + 1 < len(c.start) and j - i < 3 and c.flags[j + 1] & HAN and c.start[j + 1] == c.end[j] and c.tokens[j + 1] not in _NO_NAME:
                j += 1
        a, b = int(c.start[i]), int(c.end[j])
        words = sum(1 for k in range(i, j + 1) if c.flags[k] & (ALPHA | HAN))
        text = texts[c.doc[i]]
        after_name = 0 <= ended <= a and c.doc[i] == in_doc and LISTED.fullmatch(text, ended, a) is not None
        said = name_cue(text, a, b, words, after_name)
        if said is None:
            unsure.append((i, j + 1, "name"))
        elif said:
            gold[i : j + 1] = N_LABELS - 1
            gold[i] -= 1
            ended, in_doc = b, c.doc[i]
    return gold, unsure


def _chains(c: Coded) -> list[tuple[int, int]]:
    """Stretches of tokens that may belong to an item."""
    idx = np.flatnonzero(c.open_at)
    if not len(idx):
        return []
    cuts = np.flatnonzero((np.diff(idx) > 1) | (np.diff(c.doc[idx]) > 0)) + 1
    return list(zip(idx[np.r_[0, cuts]].tolist(), (idx[np.r_[cuts - 1, len(idx) - 1]] + 1).tolist()))


def cue_names(texts: list[str]) -> Counter:
    """How often each folded word stands, capitalised, right behind a cue of names."""
    out: Counter = Counter()
    run = re.compile(r"(?:[^\W\d_]\.[ ]?|[^\W\d_][\w’'-]+[ ]?){1,4}")
    for text in texts:
        for m in NAME_CUED.finditer(text):
            if _HAN.match(text, m.end()):
                out.update(set(re.match(r"[一-鿿]{1,4}", text[m.end() :]).group()) - _NO_NAME)
            elif (r := run.match(text, m.end())) is not None:
                out.update({fold(w) for w in re.findall(r"[^\W\d_]+", r.group()) if not w.islower() and fold(w) not in TITLES})
    return out


def train(texts: list[str], seed: int = 0) -> Field:
    """Weights by gradient steps on the sample's exact chain likelihood, in which
    open tokens count with all labels that they may have; the skip edges' by the
    log odds with which linked tokens share their kind."""
    rng = np.random.default_rng(seed)
    if not texts:
        coder = Coder.learn([], Counter())
        sizes = [len(coder.words), len(coder.forms), Coder.SHAPE_IDS]
        weights = [np.zeros((sizes[k], N_LABELS)) for k, _ in TEMPLATES] + [np.zeros((sizes[0], N_LABELS)) for _ in range(N_CONTEXT)]
        return Field(coder, weights, np.where(np.isinf(allowed_moves()), -np.inf, 0.0), np.zeros((N_LABELS, N_LABELS)))
    coder = Coder.learn(texts, cue_names(texts))
    shapes = [shape_spans(t) for t in texts]
    c = coder.encode(texts, shapes)
    gold, unsure = labelled(texts, c, shapes)
    ok = allowed_moves()
    sizes = [len(coder.words), len(coder.forms), Coder.SHAPE_IDS]
    model = Field(coder, [], np.where(np.isinf(ok), -np.inf, 0.0), np.zeros((N_LABELS, N_LABELS)))
    for passes, used in zip(PASSES, (OWN, EVERY, EVERY)):
        model.weights = [np.zeros((sizes[k], N_LABELS)) for k, _ in TEMPLATES] + [np.zeros((sizes[0], N_LABELS)) for _ in range(N_CONTEXT)]
        model.moves = np.where(np.isinf(ok), -np.inf, 0.0)
        open_spans = unsure if used is OWN else [x for x in unsure if x[2] != "name"] if passes is not PASSES[-1] else []
        _fit(model, c, gold, open_spans, passes, used, rng, ok)
        if unsure and passes is not PASSES[-1]:  # what is open is as the field now has it
            guess = _best(model, c)
            for i, j, _ in unsure:
                gold[i:j] = guess[i:j]
            gold = _mended(gold)
    model.skip = skip_weights(c, gold)
    return model


def _mended(gold: np.ndarray) -> np.ndarray:
    """Labels of further tokens that no first one stands before are first ones."""
    out = gold.copy()
    inner = np.flatnonzero((out > 0) & (out % 2 == 0))
    for i in inner:
        if i == 0 or out[i - 1] not in (out[i], out[i] - 1):
            out[i] -= 1
    return out


def _fit(model: Field, c: Coded, gold: np.ndarray, unsure: list, passes: int, used: list[bool], rng, ok: np.ndarray) -> None:
    n = len(c.start)
    may = np.full((n, N_LABELS), -1e4)
    may[np.arange(n), gold] = 0.0
    loose = np.zeros(n, dtype=bool)
    for i, j, kind in unsure:
        k = 1 + 2 * KINDS.index(kind)
        if used is not OWN and gold[i] == 0:
            continue  # the first fit has said that it is none; of others, the kind is open
        may[i:j, [0, k, k + 1] if used is OWN else [k, k + 1]] = 0.0
        loose[i:j] = True
    chains = [x for x in _chains(c) if gold[x[0] : x[1]].any() or loose[x[0] : x[1]].any() or rng.random() < SPARE]
    groups = defaultdict(list)
    for i, j in chains:
        groups[_padded(j - i)].append((i, j))
    at = np.arange(n)
    channels, context = _blurred(model.coder, c, rng)
    ids = [channels[k][np.clip(at + o, 0, n - 1)] for k, o in TEMPLATES] + context
    ids = [x for x, u in zip(ids, used) if u]
    weights = [w for w, u in zip(model.weights, used) if u]
    batches = []
    for t, spans in groups.items():
        for first in range(0, len(spans), max(1, BATCH // t)):
            rows = _rows(spans[first : first + max(1, BATCH // t)], t, n)
            flat = rows.ravel()
            real = flat < n
            own = flat[real]
            batches.append((rows.shape, flat, real, own, [_grouped(x[own]) for x in ids], bool(loose[own].any())))
    blank = np.r_[0.0, np.full(N_LABELS - 1, -1e4)]
    moves = np.zeros((N_LABELS, N_LABELS))
    grown = [np.full_like(w, 1e-6) for w in weights] + [np.full_like(moves, 1e-6)]
    for _ in range(passes):
        for q in rng.permutation(len(batches)):
            shape, flat, real, own, known, any_loose = batches[q]
            scores = np.tile(blank, (len(flat), 1))
            mine = np.zeros((len(own), N_LABELS))
            for w, (seen, place, _, _) in zip(weights, known):
                mine += w[seen][place]
            scores[real] = mine
            post, pairs, _ = beliefs(scores.reshape(*shape, N_LABELS), model.moves)
            if any_loose:
                scores[real] = mine + may[own]
                want, wanted, _ = beliefs(scores.reshape(*shape, N_LABELS), model.moves)
                diff = (want - post).reshape(-1, N_LABELS)[real]
            else:
                y = np.where(real, gold[np.minimum(flat, n - 1)], 0).reshape(shape)
                wanted = np.zeros_like(pairs)
                np.add.at(wanted, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
                diff = -post.reshape(-1, N_LABELS)[real]
                diff[np.arange(len(own)), gold[own]] += 1
            for w, g, (seen, _, order, starts) in zip(weights, grown, known):
                step = np.add.reduceat(diff[order], starts, axis=0) - SHRINK * len(own) * w[seen]
                g[seen] += step**2
                w[seen] += STEP * step / np.sqrt(g[seen])
            step = np.where(np.isinf(ok), 0, wanted - pairs)
            grown[-1] += step**2
            moves += STEP * step / np.sqrt(grown[-1])
            model.moves = np.where(np.isinf(ok), -np.inf, moves)


def _grouped(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, the place of each value among them, an order by value and where each value starts in it."""
    seen, place = np.unique(x, return_inverse=True)
    order = np.argsort(place, kind="stable").astype(np.int32)
    return seen, place.astype(np.int32), order, np.searchsorted(place[order], np.arange(len(seen)))


def _blurred(coder: Coder, c: Coded, rng) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Channels and context of the sample in which some words and endings are
    unknown, so that the field learns what to make of unknown ones."""
    n = len(c.start)
    classes = ["<pad>", "<line>", "<9>", "<han>", "<a>", "<.>"]
    word_class = np.array([i if w in classes else coder.words["<9>" if w.isdigit() else "<han>" if _HAN.match(w) else "<a>" if w[0].isalpha() else "<.>"] for i, w in enumerate(coder.words)])
    form_class = np.array([i if f[:1] == "<" and len(f) > 1 else coder.forms.get("<" + f[:2] + ">", coder.forms["<>"]) for i, f in enumerate(coder.forms)])
    word, forms, shape = c.channels
    word = np.where(rng.random(n) < BLUR[0], word_class[word], word)
    forms = np.where(rng.random(n) < BLUR[1], form_class[forms], forms)
    context = [word[np.maximum(c.first - k, 0)] for k in (1, 2, 3)] + [word[np.minimum(c.last + k, n - 1)] for k in (1, 2)]
    return [word, forms, shape], context


def _best(model: Field, c: Coded) -> np.ndarray:
    """Labels of all tokens by the chain alone."""
    labels = np.zeros(len(c.start) + 1, dtype=np.int64)
    scores, groups = _scored(model, c)
    for t, spans in groups.items():
        rows = _rows(spans, t, len(c.start))
        labels[rows] = best_labels(scores[rows], model.moves)
    return labels[:-1]


def _scored(model: Field, c: Coded) -> tuple[np.ndarray, dict]:
    """Scores of all tokens, a last row for padding, and the chains by length."""
    n = len(c.start)
    scores = np.zeros((n + 1, N_LABELS))
    scores[:, 1:] = -1e4
    rows = np.flatnonzero(c.open_at)
    scores[rows] = model.evidence(c, rows)
    groups = defaultdict(list)
    for i, j in _chains(c):
        groups[_padded(j - i)].append((i, j))
    return scores, groups


def similar(words: list[str]) -> list[int]:
    """A number for each word, the same for words that are equal or one letter
    apart (from five letters on): they share a word with one letter left out.
    Linear in the words."""
    same: dict[str, int] = {}
    known: dict[str, int] = {}
    out = []
    for w in words:
        if w not in same:
            keys = [] if len(w) < 5 else [w, *(w[:i] + "_" + w[i + 1 :] for i in range(len(w))), *(w[:i] + w[i + 1 :] for i in range(len(w)))]
            n = same[w] = next((known[k] for k in keys if k in known), len(out))
            if n == len(out):  # only the first of its like lends its keys, so that likeness isn't passed on
                for k in keys:
                    known.setdefault(k, n)
        out.append(same[w])
    return out


def skip_edges(c: Coded) -> list[tuple[int, int]]:
    """Each name-like token with the next one of the same or almost the same
    folded word in its document; Chinese characters with the next of the same
    two, so that a whole name is told from one of its characters."""
    out = []
    at = np.flatnonzero(c.named & (c.flags & (ALPHA | HAN) > 0))
    if not len(at):
        return out
    bounds = np.flatnonzero(np.diff(c.doc[at])) + 1
    for rows in np.split(at, bounds):
        if len(rows) < 2:
            continue
        keys, places = [], []
        for i in rows.tolist():
            if c.flags[i] & HAN:
                if i + 1 < len(c.tokens) and c.named[i + 1] and c.flags[i + 1] & HAN and c.doc[i + 1] == c.doc[i]:
                    keys.append(c.tokens[i] + c.tokens[i + 1])
                    places.append(i)
            elif len(c.tokens[i]) > 1 and not c.flags[i] & PARTICLE:
                keys.append(fold(c.tokens[i]))
                places.append(i)
        distinct = list(dict.fromkeys(keys))
        number = dict(zip(distinct, similar(distinct)))
        last: dict[int, int] = {}
        for k, i in zip(keys, places):
            if number[k] in last:
                out.append((last[number[k]], i))
            last[number[k]] = i
    return out


def skip_weights(c: Coded, gold: np.ndarray) -> np.ndarray:
    """Log odds of the kinds of linked tokens, held within SKIP, the same for all labels of a kind."""
    n = len(KINDS) + 1
    joint = np.full((n, n), 2.0)
    for i, j in skip_edges(c):
        a, b = KIND_OF[gold[i]], KIND_OF[gold[j]]
        joint[a, b] += 1
        joint[b, a] += 1
    p = joint / joint.sum()
    odds = np.log(p / np.outer(p.sum(axis=1), p.sum(axis=0)))
    return np.clip(SKIP * odds, -SKIP, SKIP)[np.ix_(KIND_OF, KIND_OF)]


def _padded(length: int) -> int:
    """Lengths that chains are brought to, so that few batches hold them all."""
    if length <= 4:
        return length
    step = 1 << max(1, (length - 1).bit_length() - 2)
    return -(-length // step) * step


def _rows(spans: list[tuple[int, int]], length: int, blank: int) -> np.ndarray:
    """Rows of each chain, brought to a length by a row that can only be no item."""
    s = np.array(spans)
    rows = s[:, :1] + np.arange(length)
    return np.where(rows < s[:, 1:], rows, blank)


def find(model: Field, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """Items (start, end, kind) of each text."""
    found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    shapes = [shape_spans(t) for t in texts]
    c = model.coder.encode(texts, shapes)
    if not c.open_at.any():
        return found
    scores, groups = _scored(model, c)
    blank = len(c.start)
    edges = np.array(skip_edges(c), dtype=np.int64).reshape(-1, 2)
    own = scores
    if len(edges):
        messages = np.zeros((2, len(edges), N_LABELS))
        linked = np.zeros(blank + 1, dtype=bool)
        linked[edges.ravel()] = True
        many = np.cumsum(linked)
        near = {t: _rows(s, t, blank) for t, spans in groups.items() if (s := [x for x in spans if many[x[1] - 1] > many[x[0]] - linked[x[0]]])}
        pull = np.exp(model.skip)
        for _ in range(ROUNDS):
            own = scores.copy()
            np.add.at(own, edges[:, 1], messages[0])
            np.add.at(own, edges[:, 0], messages[1])
            belief = np.full((len(scores), N_LABELS), 1e-12)
            for rows in near.values():
                belief[rows] = beliefs(own[rows], model.moves, False)[0]
            belief = np.maximum(belief, 1e-12)
            fresh = np.empty_like(messages)
            for way, (a, back) in enumerate(((0, 1), (1, 0))):
                out = belief[edges[:, a]] / np.exp(messages[back])
                out = np.log(np.maximum((out / out.sum(axis=1, keepdims=True)) @ pull, 1e-12))
                fresh[way] = out - out[:, :1]
            messages = 0.5 * messages + 0.5 * fresh
        own = scores.copy()
        np.add.at(own, edges[:, 1], messages[0])
        np.add.at(own, edges[:, 0], messages[1])
    labels = np.zeros(len(scores), dtype=np.int8)
    for t, spans in groups.items():
        rows = _rows(spans, t, blank)
        labels[rows] = best_labels(own[rows], model.moves)
    labels[blank] = 0
    n = len(labels)
    for i in np.flatnonzero(labels % 2 == 1).tolist():
        j = i + 1
        while j < n and labels[j] == labels[i] + 1:
            j += 1
        found[c.doc[i]].append((int(c.start[i]), int(c.end[j - 1]), KINDS[(labels[i] - 1) // 2]))
    return [_fit_ends(text, items, spans) for text, items, spans in zip(texts, found, shapes)]


def _fit_ends(text: str, items: list[tuple[int, int, str]], shapes: dict[str, list[tuple[int, int]]]) -> list[tuple[int, int, str]]:
    """Items with the exact ends of the shape they overlap; those that no shape of their kind meets are dropped, names are trimmed."""
    out: list[tuple[int, int, str]] = []
    for a, b, kind in items:
        if kind == "name":
            while b > a and not (text[b - 1].isalnum() or text[b - 1] == "." and re.search(r"\b[^\W\d_]\.$", text[a:b])):
                b -= 1
            while b > a and not text[a].isalnum():
                a += 1
            if b - a < 2:
                continue
        else:
            near = [(x, y) for x, y in shapes[kind] if x < b and a < y]
            if not near:
                continue
            a, b = max(near, key=lambda s: min(s[1], b) - max(s[0], a))
        if not out or a >= out[-1][1]:
            out.append((a, b, kind))
    return out


def sample(texts: DataFrame, column: str, docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> list[str]:
    """The bounded training sample: distinct texts of lowest hash. The hashes
    alone tell which these are, so no other text leaves its task."""
    rows = texts.select(F.col(column).alias("t")).where((F.char_length("t") > 0) & (F.char_length("t") <= chars)).select("t", F.xxhash64(F.lit(5), "t").alias("h"))
    last = rows.select("h").distinct().orderBy("h").limit(docs).agg(F.max("h")).first()[0]
    if last is None:
        return []
    return [r["t"] for r in rows.where(F.col("h") <= last).groupBy("h").agg(F.min("t").alias("t")).orderBy("h").limit(docs).collect()]


def save_field(model: Field, path: str) -> None:
    """Keep a fitted field in a file that all machines reach."""
    fs, base = open_fs(path)
    with fs.open_output_stream(base, compression=None) as out:
        out.write(model.save())


def load_field(path: str) -> Field:
    fs, base = open_fs(path)
    with fs.open_input_stream(base, compression=None) as f:
        return Field.load(f.read())


def items(texts: DataFrame, key: str, column: str, model: Field | None = None) -> DataFrame:
    """(key, kind, start_pos, end_pos) of every text; only narrow work, no shuffle."""
    model = model or train(sample(texts, column))
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            b = b[b["_text"].notna()]
            for group in in_groups(b[key].tolist(), b["_text"].tolist()):
                with uncollected():
                    found = find(m, [t for _, t in group])
                rows = [(k, kind, a, z) for (k, _), its in zip(group, found) for a, z, kind in its]
                if rows:
                    yield pd.DataFrame(rows, columns=[key, "kind", "start_pos", "end_pos"])

    kind = dict(texts.dtypes)[key]
    return texts.select(key, F.col(column).alias("_text")).mapInPandas(run, f"{key} {kind}, kind string, start_pos int, end_pos int")


def in_groups(keys: list, texts: list[str], chars: int = 600_000) -> Iterator[list[tuple]]:
    """Texts in groups of about so many characters."""
    group, size = [], 0
    for k, t in zip(keys, texts):
        if group and size + len(t) > chars:
            yield group
            group, size = [], 0
        group.append((k, t))
        size += len(t)
    if group:
        yield group


def redact(texts: DataFrame, key: str, column: str, model: Field | None = None) -> DataFrame:
    """(key, column): the texts with [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] and [NAME] in place of items."""
    model = model or train(sample(texts, column))
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            texts_now = [t if isinstance(t, str) else "" for t in b["_text"]]
            done = []
            for group in in_groups(list(range(len(texts_now))), texts_now):
                with uncollected():
                    found = find(m, [t for _, t in group])
                for (_, t), its in zip(group, found):
                    for a, z, kind in reversed(its):
                        t = f"{t[:a]}[{kind.upper()}]{t[z:]}"
                    done.append(t)
            yield pd.DataFrame({key: b[key], column: [d if isinstance(t, str) else None for d, t in zip(done, b["_text"])]})

    kind = dict(texts.dtypes)[key]
    return texts.select(key, F.col(column).alias("_text")).mapInPandas(run, f"{key} {kind}, {column} string")

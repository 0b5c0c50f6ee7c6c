"""Public tokenizers inside tasks: lengths or ids of whole texts.

Both classes cut texts where no token can cross, so a text is never held as
tokens in one piece, and remember what they have encoded, up to a bound."""
from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

FRAGMENT = 1 << 18  # characters of a long text that are looked at together


def fragments(text: str, safe: str, size: int = FRAGMENT) -> Iterator[str]:
    """A text in parts of about ``size`` characters that end before a match of ``safe``."""
    start, cut = 0, re.compile(safe)
    while len(text) - start > size:
        found = cut.search(text, start + size)
        if not found:
            break
        yield text[start:found.start()]
        start = found.start()
    yield text[start:]


class PieceCounter:
    """Number of tokens of texts under a sentencepiece model.

    A blank becomes the mark that begins a word, and no piece has the mark
    behind another character, so no token crosses the place before a run of
    blanks; models with such pieces are encoded whole."""

    MARK = "▁"
    SAFE = "(?<! ) "  # before the first blank of a run

    def __init__(self, path: str, batch_bytes: int = 1 << 20, memo: int = 500_000) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.cuts = not any(self.MARK in p.lstrip(self.MARK) for p in names) and self.model.encode("a  b") == self.model.encode(
            "a") + self.model.encode(" b")
        self.batch_bytes, self.memo, self.known = batch_bytes, memo, {}

    def _units(self, text: str) -> list[str]:
        """Runs of blanks with the word behind them, without the first blank: the model adds it."""
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [u[1:] for u in re.findall(" +[^ ]*", " " + text)]

    def _learn(self, units: Iterable[str]) -> None:
        """Encode new units in batches of equal bytes."""
        batch: list[str] = []
        size = 0
        for unit in units:
            batch.append(unit)
            size += 4 * len(unit) + 8
            if size >= self.batch_bytes:
                self._encode(batch)
                batch, size = [], 0
        self._encode(batch)
        self.known[""] = 1  # a single blank at the end is a mark of its own

    def _encode(self, batch: list[str]) -> None:
        if batch:
            self.known.update(zip(batch, map(len, self.model.encode(batch, num_threads=1))))

    def lengths(self, batch: list[str]) -> list[int]:
        if not self.cuts:
            return [len(x) for x in self.model.encode(batch, num_threads=1)]
        out = []
        for text in batch:
            total = 0
            text = text.replace(self.MARK, " ")  # the model does not tell them apart
            first = True
            for part in fragments(text, self.SAFE):
                if not part:
                    continue
                units = self._units(part if first else part[1:]) if first or len(part) > 1 else [""]
                first = False
                if len(self.known) > self.memo:
                    self.known.clear()
                self._learn(set(units).difference(self.known))
                total += sum(map(self.known.__getitem__, units))
            out.append(total)
        return out


class WordIds:
    """Ids of texts under a tokenizers file.

    If the file drops white space and splits by ``PATTERN``, every part of that
    split is encoded once and remembered; other files encode whole texts."""

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    PLAIN = re.compile("[!-~¡-¬®-ÿ]+")  # of these, lower case and normal form are those of the file
    SAFE = "[ \n]"
    STOP = "([a-zA-ZÀ-ÖØ-öø-ÿ])([.,;:!?]+)( |$)"  # the split parts such a letter and the marks behind it, so a blank may stand there

    def __init__(self, path: str, memo: int = 500_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_padding()
        self.model.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        suffix = spec["model"].get("end_of_word_suffix")
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.cuts = bool(suffix) and before[0].get("pattern", {}).get("Regex") == self.PATTERN and before[0].get(
            "behavior") == "Removed" and before[0].get("invert") is True
        self.cuts = self.cuts and not any(a.isalpha() or set(a) & set(".,;:!?") for a in self.added)
        if self.cuts:
            import regex

            self.split = regex.compile(self.PATTERN).findall
            self.ends = np.zeros(self.model.get_vocab_size(), bool)
            self.ends[[i for t, i in self.model.get_vocab().items() if t.endswith(suffix)]] = True
        self.dtype = np.dtype("<u2" if self.model.get_vocab_size() <= 1 << 16 else "<u4")
        self.memo, self.words, self.parts = memo, {"": b""}, {}

    def _encode(self, batch: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.model.encode_batch_fast(batch, add_special_tokens=False)]

    def _learn_parts(self, parts: list[str]) -> None:
        """Encode many parts as one text; a part ends with a token that ends a word."""
        for k in range(0, len(parts), 256):
            some = parts[k:k + 256]
            ids = np.array(self.model.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.dtype)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some) and stops[-1] == len(ids):
                raw, width = ids.tobytes(), self.dtype.itemsize
                at = [0, *(stops * width).tolist()]
                self.parts.update(zip(some, (raw[i:j] for i, j in zip(at, at[1:]))))
            else:
                self.parts.update(zip(some, self._encode(some)))

    def _learn(self, words: Iterable[str]) -> None:
        split, odd, missing = {}, [], set()
        for w in words:
            if w.isalpha() and self.PLAIN.fullmatch(w):  # one part; added tokens have other characters
                split[w] = p = [w.lower()]
                missing.add(p[0])
            elif self.PLAIN.fullmatch(w) and not any(a in w for a in self.added):
                split[w] = p = self.split(w.lower())
                missing.update(p)
            else:
                odd.append(w)
        if len(self.parts) > self.memo:
            self.parts.clear()
        self._learn_parts(list(missing.difference(self.parts)))
        parts = self.parts
        for w, p in split.items():
            self.words[w] = parts[p[0]] if len(p) == 1 else b"".join([parts[x] for x in p])
        self.words.update(zip(odd, self._encode(odd)))

    def ids(self, batch: list[str]) -> list[np.ndarray]:
        """Ids of every text, without special tokens but those that stand in it."""
        if not self.cuts:
            return [np.frombuffer(x, self.dtype) for x in self._encode(batch)]
        out: list[list[np.ndarray]] = [[] for _ in batch]
        held, size = [], 0
        for n, text in enumerate(batch):
            for part in fragments(text, self.SAFE):
                held.append((n, part))
                size += len(part)
                if size >= 4 * FRAGMENT:
                    self._flush(held, out)
                    held, size = [], 0
        self._flush(held, out)
        return [x[0] if len(x) == 1 else np.concatenate([np.zeros(0, self.dtype), *x]) for x in out]

    def _flush(self, held: list[tuple[int, str]], out: list[list[np.ndarray]]) -> None:
        """Arrow splits the texts and numbers their words, so Python sees each different word once; the
        ids of all words are then gathered from those of the different ones."""
        if not held:
            return
        if len(self.words) > self.memo:
            self.words = {"": b""}
        whole = pc.replace_substring(pa.array([t for _, t in held], pa.string()), "\n", " ")
        lists = pc.split_pattern(pc.replace_substring_regex(whole, self.STOP, r"\1 \2\3"), " ")
        numbered = lists.flatten().dictionary_encode()
        words = numbered.dictionary.to_pylist()
        self._learn(set(words).difference(self.words))
        known = [self.words[w] for w in words]
        pool, size = np.frombuffer(b"".join(known), self.dtype), np.fromiter(map(len, known), np.int32, len(known)) // self.dtype.itemsize
        at = numbered.indices.to_numpy()
        sizes = size[at]
        ends = np.append(np.int32(0), np.cumsum(sizes, dtype=np.int32))  # a flush has far fewer than 2^31 ids
        begins = np.cumsum(size, dtype=np.int32) - size
        found = pool[np.repeat(begins[at] - ends[:-1], sizes) + np.arange(ends[-1], dtype=np.int32)]
        bounds = ends[lists.offsets.to_numpy()].tolist()
        for (n, _), i, j in zip(held, bounds, bounds[1:]):
            out[n].append(found[i:j])


_LOADED: dict[tuple, object] = {}


def counter(path: str, **options):
    """Token counter of a ``.model`` or ``.json`` file, one per Python worker."""
    key = ("count", path, *sorted(options.items()))
    if key not in _LOADED:
        if path.endswith(".model"):
            _LOADED[key] = PieceCounter(path, **options).lengths
        else:
            ids = word_ids(path).ids
            _LOADED[key] = lambda batch: [len(x) for x in ids(batch)]
    return _LOADED[key]


def word_ids(path: str) -> WordIds:
    if ("ids", path) not in _LOADED:
        _LOADED["ids", path] = WordIds(path)
    return _LOADED["ids", path]

"""Exact, memory-bounded encoding of many texts with a public tokenizer.

The tokenizers library spends most of its time on normalizing, cutting and merging the
same words again and again. Both tokenizers used here never merge across the border
between a character that isn't white space and white space after it, so a text may be
encoded piece by piece. Arrow cuts the texts of a batch at single blanks and line ends and
numbers the distinct pieces; their ids come from a bounded cache or, many new pieces at a
time, from the library, and are put together by numpy. A new piece of plain letters with
ASCII punctuation after it is cut by rule and given to the library's model without its
normalizer and pattern; all others are encoded by the whole library. A text with other
white space than single blanks and line ends is cut by the general rule.
The result is what the library gives for the whole text, as the tests check.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Unicode White_Space, which is what the tokenizers' patterns call white space.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_CHUNKS = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+").findall
#: A word of Latin letters with ASCII punctuation after it. No apostrophe: it may begin
#: a contraction. The border between the two is always a border of tokens.
_PLAIN = r"^(?P<line>\n?)(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[!-&(-/:-@\[-`{-~]*)$"
_ENDS_IN_SPACE = re.compile(f"[{_SPACE}]$").search
#: A blank at which a long text may be cut.
_BORDER = re.compile(f"(?<=[^{_SPACE}]) (?=[^{_SPACE}])")
#: Stands between the parts of plain pieces, and before the first piece of a text.
_CUT, _HEAD = "\x1f", "\0"
#: Byte-level tokenizers number the bytes that don't print from 256 on.
_UNPRINTED = [*range(33), *range(127, 161), 173]
_SHIFTED = np.arange(256, dtype="<u4")
_SHIFTED[_UNPRINTED] = 256 + np.arange(len(_UNPRINTED))
_SHIFTED[ord(_CUT)] = ord(_CUT)


def _strings(a: pa.Array) -> list[str]:
    return a.to_numpy(zero_copy_only=False).tolist()


def _byte_letters(text: str) -> str:
    """The letters that byte-level tokenizers write for the bytes of letters, ASCII
    punctuation, blanks and line ends."""
    if text.isascii():
        return text.replace(" ", "Ġ").replace("\n", "Ċ")
    return _SHIFTED[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-32-le")


class _Recent(dict):
    """Entries of about the last ``most`` to twice ``most`` that were put or found anew."""

    def __init__(self, most: int) -> None:
        self.most, self.old = most, {}

    def age(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()

    def found(self, keys: list[str]) -> tuple[list, list[int]]:
        """Values of the keys, None for those that aren't here; the places of these."""
        out = list(map(self.get, keys))
        missing = [k for k, x in enumerate(out) if x is None]
        if self.old:
            for k in missing:
                if (x := self.old.get(keys[k])) is not None:
                    out[k] = self[keys[k]] = x
            missing = [k for k in missing if out[k] is None]
        return out, missing


class Encoder:
    """Texts to token ids, each id as four little-endian bytes."""

    def __init__(self, path: str, most: int = 600_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers


        self.lib = Tokenizer.from_file(path)
        #: The same merges for words that are cut, and if need be lower-cased, already.
        self.merge = Tokenizer(self.lib.model)
        self.merge.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(_CUT)
        vocab = self.lib.get_vocab()
        self.size = max(vocab.values()) + 1
        #: Word-end BPE drops white space and lower-cases; else a word carries its blank.
        self.ends = any(k.endswith("</w>") for k in vocab)
        self.border = np.zeros(self.size, bool)
        for k, i in vocab.items():
            self.border[i] = k.endswith("</w>") if self.ends else k.startswith("Ġ") or k == "Ċ"
        self.pieces, self.chunks = _Recent(most), _Recent(most // 4)

    def _one(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, line: pa.Array, letters: pa.Array, tail: pa.Array) -> list[bytes] | None:
        """Ids of plain pieces; None if the tokens' borders don't tell the pieces apart."""
        bare = pc.equal(tail, "")
        tail = pc.if_else(bare, "", pc.binary_join_element_wise(_CUT, tail, ""))
        # a line end is a token by itself, with no part in the word after it
        lead = "" if self.ends else pc.if_else(pc.equal(line, ""), " ", "\n" + _CUT)
        words = pc.binary_join_element_wise(lead, pc.utf8_lower(letters) if self.ends else letters, tail, "")
        joined = _byte_letters(_CUT.join(_strings(words)))
        ids = np.array(self.merge.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        border = np.flatnonzero(self.border[ids])
        if self.ends:  # the last token of a word and of its punctuation
            parts = np.cumsum(np.where(bare.to_numpy(zero_copy_only=False), 1, 2))
            if len(border) != parts[-1]:
                return None
            ends = border[parts - 1] + 1
        else:
            if len(border) != len(words):
                return None
            ends = np.append(border[1:], len(ids))
        data, ends = ids.tobytes(), (4 * ends).tolist()
        return [data[a:z] for a, z in zip([0, *ends], ends, strict=False)]

    def _learn(self, pieces: list[str]) -> list[bytes | bool]:
        """Ids of pieces; False for white space that belongs to what follows."""
        out: list = [None] * len(pieces)
        match = pc.extract_regex(pa.array(pieces, pa.string()), _PLAIN)
        plain = np.flatnonzero(match.is_valid().to_numpy(zero_copy_only=False))
        if len(plain):
            found = self._plain(*match.take(pa.array(plain)).flatten())
            for k, x in zip(plain.tolist(), found or (), strict=False):
                out[k] = x
        for k, p in enumerate(pieces):
            if out[k] is None:
                if p[:1] == _HEAD:
                    out[k] = False if _ENDS_IN_SPACE(p) else self._one(p[1:])
                elif not p or _ENDS_IN_SPACE(p):
                    out[k] = False
                else:
                    out[k] = self._one(p if p[0] == "\n" else " " + p)
        self.pieces.update(zip(pieces, out, strict=True))
        return out

    def _general(self, text: str) -> bytes:
        out = []
        for c in _CHUNKS(text):
            if (x := self.chunks.get(c)) is None:
                x = self.chunks[c] = self._one(c)
            out.append(x)
        return b"".join(out)

    def _batch(self, texts: list[str]) -> list[bytes]:
        if any(_HEAD in t for t in texts):
            return [self._general(t) for t in texts]
        for cache in (self.pieces, self.chunks):
            cache.age()
        cut = pc.replace_substring(pa.array(texts, pa.string()), "\n", " \n")
        cut = pc.split_pattern(cut if self.ends else pc.binary_join_element_wise(_HEAD, cut, ""), " ")
        numbered = cut.flatten().dictionary_encode()
        kinds = _strings(numbered.dictionary)
        found, missing = self.pieces.found(kinds)
        if missing:
            for k, x in zip(missing, self._learn([kinds[k] for k in missing]), strict=True):
                found[k] = x
        odd = np.array([x is False for x in found])
        parts = [x or b"" for x in found]
        sizes = np.array([len(x) for x in parts]) // 4
        pool, starts = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(sizes) - sizes
        piece, edge = numbered.indices.to_numpy(), cut.offsets.to_numpy()
        size = sizes[piece]
        upto = np.concatenate([[0], np.cumsum(size)])
        data = pool[np.repeat(starts[piece] - upto[:-1], size) + np.arange(upto[-1])].tobytes()
        ends = 4 * upto[edge]
        out = [data[a:z] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        strange = np.concatenate([[0], np.cumsum(odd[piece])])[edge]
        for k in np.flatnonzero(np.diff(strange)).tolist():
            out[k] = self._general(texts[k])
        return out

    def encode(self, texts: list[str], most: int = 4 << 20) -> list[bytes]:
        """Ids of each text; about ``most`` characters are worked on at a time."""
        out: list[list[bytes]] = []
        held: list[tuple[int, str]] = []

        def end() -> None:
            if held:
                for (k, _), ids in zip(held, self._batch([t for _, t in held]), strict=True):
                    out[k].append(ids)
            held.clear()

        size = 0
        for k, t in enumerate(texts):
            out.append([])
            while len(t) > most and (m := _BORDER.search(t, most)):
                held.append((k, t[: m.start()]))
                t, size = t[m.start() :], 0
                end()
            held.append((k, t))
            size += len(t)
            if size > most:
                end()
                size = 0
        end()
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]


_KEPT: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, that of the last vocabulary asked for."""
    if path not in _KEPT:
        let_go()
        _KEPT[path] = Encoder(path)
    return _KEPT[path]


def let_go() -> None:
    """Frees the encoder. A Python worker goes on with other operators' tasks, which call
    this so that the caches of one don't stand beside the data of another."""
    _KEPT.clear()

"""Exact token ids of whole texts with a byte-level BPE of the tokenizers library, remembering pieces.

The library's pre-tokenizer takes a blank together with the characters that follow it, no alternative of its pattern
reaches from other characters into white space, and of a run of white space before another character only the last is
apart from the rest.  So a text may be cut before every blank and around every line feed, and its ids are those of its
pieces one after another, unless it has two white spaces with a third or the end behind them (or a special token's string);
only such texts are cut by a slower pattern, where white space follows other characters.

A batch is cut, its pieces are numbered and its ids are put together by Arrow and numpy; Python sees each piece once a
step, and the library sees it once for as long as the memory of ``most`` pieces lasts.  A full memory forgets the pieces
that came only once, of the others the rarer ones above half of it.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import held

TOKENIZER = "byte_bpe_50k.json"
#: Pieces, and their ids, held by one Python worker before it forgets the rare ones (about 150 bytes a piece).
MOST_PIECES = 500_000
MOST_IDS = 8 * MOST_PIECES
#: Bytes of text that are cut at a time.
STEP_BYTES = 8 << 20

#: Two white spaces and more of it (or the end); for Arrow's engine, whose \s is ASCII only, by code points.
_SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_RUN = rf"{_SPACE}{_SPACE}({_SPACE}|\z)"
_CUT = re.compile(r"(?<=\S)(?=\s)")
#: Pieces that can be encoded side by side, a line feed between them: no white space but a leading blank.
_PLAIN = re.compile(r" ?\S+\Z")
#: Latin letters and the signs after them: the pattern parts these anyway, and apart they are known more often.
_SIGNED = r"^([A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+)([!-/:-@\[-`{-~]+)$"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (lengths[0] numbers), then those of the next."""
    ends = np.cumsum(lengths)
    out = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)
    some = np.flatnonzero(lengths)
    if not len(some):
        return out
    heads = ends[some] - lengths[some]
    out[heads] = starts[some]
    out[heads[1:]] -= starts[some[:-1]] + lengths[some[:-1]] - 1
    return np.cumsum(out, out=out)


class PieceEncoder:
    def __init__(self, path: str, most: int = MOST_PIECES, most_ids: int = MOST_IDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        rule = self.tokenizer.pre_tokenizer
        self.parts_signs = isinstance(rule, pre_tokenizers.ByteLevel) and rule.use_regex and self.tokenizer.normalizer is None
        self.most, self.most_ids = most, most_ids
        # a special token's string ends what the pattern sees, like the end of the text
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.slow = "|".join([_RUN, *special])
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.ids, self.n_ids = np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32), 0
        # how often each piece came since the memory was full
        self.uses = np.zeros(1 << 12, np.int64)

    def _forget_rare(self) -> None:
        """Keep the pieces that came more than once, of too many the more frequent ones with no more than half of all ids."""
        n = len(self.known)
        often = np.argsort(-self.uses[:n], kind="stable")[: self.most // 2]
        often = often[self.uses[often] > 1]
        sizes = self.starts[often + 1] - self.starts[often]
        keep = np.sort(often[np.cumsum(sizes) <= self.most_ids // 2])
        at, size = self.starts[keep], self.starts[keep + 1] - self.starts[keep]
        ids, pieces = self.ids[_spread(at, size)] if len(keep) else self.ids[:0], list(self.known)
        self._forget()
        if len(keep):
            self._keep([pieces[i] for i in keep.tolist()], ids, np.cumsum(size))
            self.uses[: len(keep)] = 1  # to stay again, once more is enough

    def _encoded(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        """Pieces as they stand in the text.  Most are encoded as lines of one text, which costs the library half as much."""
        lines, others = [], []
        for p in pieces:
            (lines if _PLAIN.match(p) else others).append(p)
        feed = self._encoded(["\n"])[0][0]
        for lo in range(0, len(lines), 256):
            some = lines[lo : lo + 256]
            got = np.array(self._encoded(["\n".join(some) + "\n"])[0], np.uint32)
            ends = np.flatnonzero(got == feed)
            if len(ends) != len(some):  # the tokenizer has an id that holds a line feed and more: one by one
                others += some
                continue
            self._keep(some, got[got != feed], ends - np.arange(len(ends)))
        for lo in range(0, len(others), 1024):
            some = others[lo : lo + 1024]
            got = self._encoded(some)
            self._keep(some, np.concatenate([np.array(g, np.uint32) for g in got]), np.cumsum([len(g) for g in got]))

    def _keep(self, pieces: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        n = len(self.known)
        if n + len(pieces) + 1 > len(self.starts):
            more = np.zeros(max(len(self.starts), len(pieces) + 1), np.int64)
            self.starts, self.uses = np.append(self.starts, more), np.append(self.uses, more)
        if self.n_ids + len(ids) > len(self.ids):
            self.ids = np.append(self.ids, np.zeros(max(len(self.ids), len(ids)), np.uint32))
        self.starts[n + 1 : n + 1 + len(pieces)] = self.n_ids + ends
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.n_ids += len(ids)
        self.known.update(zip(pieces, range(n, n + len(pieces))))

    def _have(self, pieces: list[str]) -> None:
        """See to it that distinct pieces are known; may forget others, so it is asked once for all pieces of a step."""
        missing = [p for p in pieces if p not in self.known]
        if missing and self.known and (len(self.known) + len(missing) > self.most or self.n_ids > self.most_ids):
            self._forget_rare()
            missing = [p for p in pieces if p not in self.known]
        self._learn(missing)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has; a null is empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        ids, counts, lo = [], [], 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STEP_BYTES, side="right")))
            some = self._step(texts.slice(lo, hi - lo))
            ids.append(some[0])
            counts.append(some[1])
            lo = hi
        return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _step(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = np.flatnonzero(pc.match_substring_regex(texts, self.slow).to_numpy(zero_copy_only=False))
        slow = {int(i): _CUT.split(texts[int(i)].as_py()) for i in odd}
        if slow:
            mask = np.zeros(len(texts), bool)
            mask[odd] = True
            texts = pc.if_else(pa.array(mask), pa.scalar("", pa.large_string()), texts)
        by_line = pc.split_pattern(texts, "\n")
        lines = by_line.offsets.to_numpy().astype(np.int64)
        cut = pc.split_pattern(by_line.flatten(), " ")
        begin = cut.offsets.to_numpy().astype(np.int64)
        coded = cut.flatten().dictionary_encode()
        number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # every piece but a line's first begins with the blank that was cut away
        head = np.zeros(len(number), bool)
        head[begin[:-1] - begin[0]] = True
        # signs at a piece's end are a piece of their own, without a blank
        words = pc.replace_substring_regex(coded.dictionary, _SIGNED, r"\1") if self.parts_signs else coded.dictionary
        signed = pc.binary_length(words).to_numpy(zero_copy_only=False) < pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False)
        signs = pc.replace_substring_regex(coded.dictionary.filter(pa.array(signed)), _SIGNED, r"\2")
        both = pa.concat_arrays([words, signs]).dictionary_encode()
        code = both.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        sign = np.full(len(words), -1, np.int64)
        sign[signed] = code[len(words) :]
        after = sign[number]
        where = np.flatnonzero(after >= 0)
        ends = np.arange(1, len(number) + 1)
        ends += np.cumsum(after >= 0)
        begin = np.append(0, ends)[begin - begin[0]]
        number, head = np.insert(code[number], where + 1, after[where]), np.insert(head, where + 1, True)
        size, first = np.diff(begin), begin[:-1]
        pieces = both.dictionary.to_numpy(zero_copy_only=False)
        heads, inner = (np.flatnonzero(np.bincount(number[m], minlength=len(pieces))) for m in (head, ~head))
        at_head, inside = pieces[heads].tolist(), [" " + p for p in pieces[inner].tolist()]
        asked = ["\n", *at_head, *inside]
        if slow:
            asked = list(dict.fromkeys([*asked, *(p for parts in slow.values() for p in parts)]))
        self._have(asked)
        place = self.known
        as_head, as_inner = np.zeros((2, len(pieces)), np.int64)
        as_head[heads] = [place[p] for p in at_head]
        as_inner[inner] = [place[p] for p in inside]
        number = np.where(head, as_head[number], as_inner[number])
        self.uses[: len(place)] += np.bincount(number, minlength=len(place))
        # a line feed stands before every line but a text's first
        fed = np.ones(len(first), bool)
        fed[lines[:-1] - lines[0]] = False
        number = np.insert(number, first[fed], place["\n"])
        size = np.add.reduceat(size + fed, lines[:-1] - lines[0])
        if slow:
            bits, last, edges = [], 0, np.append(0, np.cumsum(size))
            for i, parts in slow.items():
                bits += [number[last : edges[i]], np.array([place[p] for p in parts], np.int64)]
                size[i], last = len(parts), edges[i + 1]
            number = np.concatenate([*bits, number[last:]])
        lengths = self.starts[number + 1] - self.starts[number]
        ids = self.ids[_spread(self.starts[number], lengths)]
        total = np.append(0, np.cumsum(lengths))
        edges = np.append(0, np.cumsum(size))
        return ids, total[edges[1:]] - total[edges[:-1]]


def encoder(path: str) -> PieceEncoder:
    """One encoder for each Python worker, so that tasks share what it remembers."""
    return held(("encoder", path), lambda: PieceEncoder(path))

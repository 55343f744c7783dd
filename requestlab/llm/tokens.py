"""Token ids and token counts with a public tokenizer, word by word.

The tokenizer's own normaliser and splitter never let a pre-token cross white space, so a
text's ids are those of its white-space chunks in turn.  Arrow cuts a column of texts into
chunks and names the distinct ones; each of those is looked up or encoded once.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shingles import spread

SPECIAL = re.compile(r"(<\|startoftext\|>|<\|endoftext\|>)")
#: Chunks of these characters alone are split into pre-tokens here: visible ones up to U+017F (but for
#: U+0130, whose lower case is two characters), Cyrillic letters and general punctuation.  For them
#: lower-casing, NFC and the letter and digit classes agree with the library's.
_PLAIN = "^[!-~¡-įı-ſЀ-ҁ‐-‧‰-⁞]+$"
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼-¾]+|[\d²³¹¼-¾]|(?:[^\w\s]|_)+")
_GAP = re.compile(r"[\t-\r ]")
#: Bytes of text that are cut into chunks at once.
SLICE = 12_000_000


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return table


def prove_whole_tokens(path: str) -> dict[str, int]:
    """Vocabulary strings that alone encode as one token: ``{pre-token: id}``.

    For every entry with a word end the string before it is encoded by the library itself;
    it is listed if it comes back as exactly that id.  Run once, on the driver; bounded by the
    vocabulary.
    """
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    back = {c: b for b, c in _byte_letters().items()}
    words = []
    for entry, i in json.loads(tok.to_str())["model"]["vocab"].items():
        if entry.endswith("</w>"):
            try:
                words.append((bytes(back[c] for c in entry[:-4]).decode(), i))
            except (KeyError, UnicodeDecodeError):
                continue
    out = {}
    for (w, i), e in zip(words, tok.encode_batch([w for w, _ in words], add_special_tokens=False), strict=True):
        if e.ids == [i]:
            out[w] = i
    return out


def slices(column: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """A column of texts in parts of about SLICE bytes: (texts, the row of each, whether it ends its row); null is empty.

    A longer text comes in several parts, cut at white space.
    """
    column = pc.fill_null(column, "")
    size = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    at, n = 0, len(column)
    while at < n:
        if size[at] > SLICE:
            text, a = column[at].as_py(), 0
            while a < len(text):
                gap = _GAP.search(text, a + SLICE // 4)
                b = gap.start() if gap else len(text)
                yield pa.array([text[a:b]]), np.array([at]), np.array([b == len(text)])
                a = b
            at += 1
            continue
        upto = at + max(1, int(np.searchsorted(np.cumsum(size[at:]), SLICE, side="right")))
        yield column.slice(at, upto - at), np.arange(at, upto), np.ones(upto - at, bool)
        at = upto


def chunks(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct white-space chunks, the number of each chunk in turn, and where each text's chunks begin (and end)."""
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    bounds = lists.offsets.to_numpy().astype(np.int64)
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), bounds - bounds[0]


class WordEncoder:
    """Ids, or numbers of ids, of texts by their distinct white-space chunks.

    A plain chunk is one run of letters or splits into pre-tokens; those that are proven whole
    tokens are read off the table, the rest is merged by the library's model, once each in a
    slice of texts.  Other chunks go to the library as they stand.
    """

    def __init__(self, path: str, whole: dict[str, int], counts: bool):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        if not counts and self.tok.get_vocab_size() > 65536:
            raise ValueError("ids above 65535 need a wider file format")
        self.letters = [_byte_letters()[b] for b in range(256)]
        self.counts = counts
        self.words, self.ids = pa.array(whole), np.fromiter(whole.values(), np.uint16, len(whole))
        self.taken = self.merged = 0  # distinct pre-tokens that the table served, and the library

    def _merge(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pre-tokens merged by the library's model."""
        merge, letters = self.model.tokenize, self.letters.__getitem__
        spelled = (p if p.isascii() else "".join(map(letters, p.encode())) for p in pieces)
        return self._encoded(map(merge, spelled) if self.counts else ([t.id for t in merge(p)] for p in spelled))

    def _whole(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Chunks that the library encodes as they stand."""
        return self._encoded(e.ids for e in self.tok.encode_batch(chunks, add_special_tokens=False)) if chunks else self._encoded(iter(()))

    def _encoded(self, values: Iterator[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all values in one array, number of ids of each); counts need no ids."""
        if self.counts:
            return np.empty(0, np.uint16), np.fromiter(map(len, values), np.int64)
        ids, ends = array("H"), [0]
        for value in values:
            ids.extend(value)
            ends.append(len(ids))
        return np.frombuffer(ids, np.uint16), np.diff(ends)

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, size) of distinct pre-tokens: proven ones from the table, the rest merged."""
        at = pc.index_in(pieces, self.words)
        proven = at.is_valid().to_numpy(zero_copy_only=False)
        self.taken, self.merged = self.taken + int(proven.sum()), self.merged + int((~proven).sum())
        rest, size = self._merge(pieces.filter(pc.invert(at.is_valid())).to_numpy(zero_copy_only=False).tolist())
        start, sizes = np.zeros(len(pieces), np.int64), np.ones(len(pieces), np.int64)
        start[proven] = at.drop_null().to_numpy()
        start[~proven], sizes[~proven] = len(self.ids) + np.cumsum(size) - size, size
        return np.concatenate([self.ids, rest]), start, sizes

    def lookup(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, size) of distinct chunks, which hold no ASCII white space."""
        # a special token may stand anywhere in a chunk
        plain = pc.and_not(pc.match_substring_regex(names, _PLAIN), pc.match_substring(names, "<|"))
        low = pc.utf8_lower(names.filter(plain))
        letters = pc.utf8_is_alpha(low)
        split = list(map(_PIECES.findall, low.filter(pc.invert(letters)).to_numpy(zero_copy_only=False).tolist()))
        count = np.ones(len(low), np.int64)
        count[~letters.to_numpy(zero_copy_only=False)] = np.fromiter(map(len, split), np.int64, len(split))
        coded = pa.concat_arrays([low.filter(letters), pa.array([p for c in split for p in c], low.type)]).dictionary_encode()
        ids, start, size = self._pieces(coded.dictionary)
        # runs of letters come first in ``coded``, the pieces of the others behind them
        one = letters.to_numpy(zero_copy_only=False)
        first = np.empty(len(low), np.int64)
        first[one] = np.arange(one.sum())
        first[~one] = one.sum() + np.cumsum(count[~one]) - count[~one]
        index = coded.indices.to_numpy(zero_copy_only=False)[spread(first, count)]
        n = size[index]
        before = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(count)])]
        other, other_n = self._whole(names.filter(pc.invert(plain)).to_numpy(zero_copy_only=False).tolist())
        flat = np.empty(0, np.uint16) if self.counts else np.concatenate([ids[spread(start[index], n)], other])
        is_plain = plain.to_numpy(zero_copy_only=False)
        out_start, out_size = np.empty(len(names), np.int64), np.empty(len(names), np.int64)
        out_start[is_plain], out_size[is_plain] = before[:-1], np.diff(before)
        out_start[~is_plain], out_size[~is_plain] = before[-1] + np.cumsum(other_n) - other_n, other_n
        return flat, out_start, out_size

    def encode(self, column: pa.Array, end: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Ids of a column of texts in portions: (ids, rows, how many of the ids are each row's, whether the row is done).

        ``end`` follows every row.
        """
        for texts, rows, closed in slices(column):
            names, index, bounds = chunks(texts)
            ids, start, size = self.lookup(names)
            if end is not None:  # one more chunk behind each text
                index = np.insert(index.astype(np.int64), bounds[1:][closed], len(names))
                bounds = bounds + np.concatenate([[0], np.cumsum(closed)])
                ids, start, size = np.append(ids, np.uint16(end)), np.append(start, len(ids)), np.append(size, 1)
            n = size[index]
            before = np.concatenate([[0], np.cumsum(n)])
            yield ids[spread(start[index], n)], rows, before[bounds[1:]] - before[bounds[:-1]], closed

    def count(self, column: pa.Array) -> np.ndarray:
        """Number of ids of each text of a column."""
        total = np.zeros(len(column), np.int64)
        for texts, rows, _ in slices(column):
            names, index, bounds = chunks(texts)
            before = np.concatenate([[0], np.cumsum(self.lookup(names)[2][index])])
            np.add.at(total, rows, before[bounds[1:]] - before[bounds[:-1]])
        return total


_encoders: dict[tuple[str, bool], WordEncoder] = {}


def encoder(path: str, whole: dict[str, int], counts: bool) -> WordEncoder:
    """One encoder a worker process; it survives from task to task."""
    key = (path, counts)
    if key not in _encoders:
        _encoders[key] = WordEncoder(path, whole, counts)
    return _encoders[key]


def count_tokens(docs, path: str, limit: int = 2048):
    """Token counts of whole texts: ``doc_id, n_bytes, n_tokens, over_limit``.

    No row leaves its partition.  Null text counts as empty (0 tokens); a very long text is
    counted in parts cut at white space; doc_id may be null or repeated; further columns are
    ignored; an empty table gives no rows.
    """
    proven = docs.sparkSession.sparkContext.broadcast(prove_whole_tokens(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, proven.value, True)
        for batch in batches:
            n = enc.count(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64()),
                    pa.array(n),
                    pa.array(n > limit),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


assert sys.byteorder == "little"

"""Byte-level BPE encoding and decoding by recursive queries in DuckDB, one database per Python worker.

The pattern splits a text into words; each distinct word not met before goes to DuckDB as rows (word,
position, token), one per byte. The merge table has a row for every split of every vocabulary entry
into two entries. A recursive query joins neighbouring rows with it, picks each word's least rank,
leftmost first, and contracts it, until a word has no pair left. Words that are entries themselves keep
their rank. Decoding is an ordered aggregation of the tokens' bytes in the same query.

Long words are contracted at many places in a round. A pair may go before all else where no vocabulary
entry that occurs there, begins and ends at borders of tokens now, and reaches over one of the pair's ends
has a lower rank: nothing that comes first could take one of its tokens, and what its merging allows ranks
higher. Of a run of overlapping equal pairs every other one goes, up to the first that must wait; the pair
of the least rank always goes. So the rounds follow how deep such waits nest, not the length of the word.
Before, a long word is cut where no occurring entry reaches across, as no merge can.

Words repeat, so a worker keeps what it has encoded (a bounded number of words). Texts are worked on in
slices of bounded size, and nothing is shuffled. DuckDB may not spill; a query holds at most ROWS rows of
rounds and HELD bytes of long words, so its memory follows only a single unbroken piece longer than that
(some 600 bytes for each of its bytes; its limit is raised accordingly).

Defined cases: a null or empty text has no tokens; ids_sha256 and decoded_sha256 are those of no bytes.
Null doc_ids and repeated rows pass through; very long texts and words are encoded whole; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.llm._common import bounded_batches

#: White space as the tokenizer's pattern language has it (the control separators aren't).
_SPACE = r"\t-\r \x85\xa0  -     　"
#: Characters of text worked on at once, and words remembered.
SLICE = 2_000_000
REMEMBERED = 300_000
#: What DuckDB may hold.
MEMORY = "350MB"

#: Words of up to so many bytes take the query that contracts one pair a round; longer ones contract at many places.
SHORT = 48
#: Bytes of long words in one query, and rows that its rounds may add up to.
HELD = 200_000
ROWS = 2_000_000

_KNOWN = """
with recursive
known as (select w.word, v.tok from waiting w join vocab v on v.hex = w.hex where w.whole),
bytes as (
  select w.word, w.i, v.tok
  from (select word, hex, unnest(range(length(hex) // 2)) as i from waiting anti join known using (word)) w
  join vocab v on v.hex = substr(w.hex, 2 * w.i + 1, 2)
),
"""
_FINISH = """
last as (select t.word, t.pos, t.tok from rounds t join (select word, max(round) as round from rounds group by word) using (word, round)),
final as (select word, pos, tok from last union all select word, 0, tok from known)
select f.word, string_agg(f.tok::varchar, ' ' order by f.pos) as ids, string_agg(v.hex, '' order by f.pos) as hex
from final f join vocab v using (tok) group by f.word
"""
#: wp is word << 16 | position; a round contracts the least (rank, position) of each word.
_ENCODE_SHORT = (
    _KNOWN
    + """
t(wp, tok, round) as (
  select word::bigint << 16 | i, tok, 0 from bytes
  union all
  (
    with best as (
      select x.wp >> 16 as word, min(m.merged::bigint << 16 | (x.wp & 65535)) as b
      from t x join t y on y.wp = x.wp + 1 join merges m on m.pair = (x.tok::bigint << 20 | y.tok)
      group by 1
    )
    select t.wp - ((t.wp & 65535) > (b & 65535))::int, case when (t.wp & 65535) = (b & 65535) then (b >> 16)::int else t.tok end, t.round + 1
    from t join best on best.word = t.wp >> 16 where (t.wp & 65535) <> (b & 65535) + 1
  )
),
rounds as (select wp >> 16 as word, wp & 65535 as pos, tok, round from t),
"""
    + _FINISH
)
#: Up to ROUNDS rounds over the table state (word, s, e, tok: bytes s to e); occ has the entries that occur (word, s, e, rank, area).
_CONTRACT = """
create or replace temp table after as
with recursive t(word, s, e, tok, round) as (
  select word, s, e, tok, 0 from state
  union all
  (
    with live as materialized (
      select word, s, e, tok, round, row_number() over w as k, lead(tok) over w as after, lead(e) over w as until
      from t where round < ROUNDS window w as (partition by word order by s)
    ), pairs as materialized (
      select word, s, k, merged as r from live join merges m on m.pair = (tok::bigint << 20 | after)
    ), highest as (
      select word, area + away as area, max(r) as r from (select word, s // AREA as area, max(r) as r from pairs group by all), (select unnest([-1, 0, 1]) as away) group by all
    ), aligned as (
      select o.word, o.rank, a.k as first, b.k as last
      from occ o join highest h on h.word = o.word and h.area = o.area and o.rank <= h.r
      join live a on a.word = o.word and a.s = o.s join live b on b.word = o.word and b.e = o.e
      where b.k > a.k
    ), reach as materialized (
      select *, unnest(range(first, last)) as border from aligned
    ), waits as (
      select p.word, p.k from pairs p join reach x on x.word = p.word and x.border = p.k - 1
      where x.rank < p.r or x.rank = p.r and (x.first <> p.k - 1 or x.last <> p.k)
      union
      select p.word, p.k from pairs p join reach x on x.word = p.word and x.border = p.k + 1 where x.rank < p.r
    ), runs as (
      select p.*, w.k is not null as waiting, p.k - row_number() over (partition by p.word, p.r order by p.k) as run,
             row_number() over (partition by p.word order by p.r, p.k) as nth
      from pairs p left join waits w on w.word = p.word and w.k = p.k
    ), ordered as (
      select *, row_number() over u as place, sum(waiting::int) over u as stopped from runs window u as (partition by word, r, run order by k)
    ), picked as materialized (
      select word, k, r from ordered where nth = 1 or stopped = 0 and place % 2 = 1
    )
    select l.word, l.s, case when p.k is null then l.e else l.until end, coalesce(p.r, l.tok), l.round + 1
    from live l left join picked p on p.word = l.word and p.k = l.k
    where l.word in (select word from picked)
      and not exists (select 1 from picked q where q.word = l.word and q.k = l.k - 1)
  )
)
select word, s, e, tok, round from t join (select word, max(round) as round from t group by word) using (word, round)
"""
_GATHER = "select s.word, string_agg(s.tok::varchar, ' ' order by s.s) as ids, string_agg(v.hex, '' order by s.s) as hex from state s join vocab v using (tok) group by s.word"


class Codec:
    """Encoder and decoder of one rank file. encoded: word -> (ids as text, bytes they decode to)."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        ranks = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        rows = []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    rows.append((a, b, rank))
        self.ranks, self.finder, self.area = ranks, None, 2 * max(map(len, ranks), default=1)
        self.split = regex.compile(pattern.replace(r"[^\s", "[^" + _SPACE).replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")).findall
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        vocab = pd.DataFrame({"tok": list(ranks.values()), "hex": [t.hex() for t in ranks]})  # noqa: F841
        merges = pd.DataFrame(rows, columns=["a", "b", "merged"])
        self.db.register("v", vocab)
        self.db.register("m", merges)
        self.db.execute("create table vocab as select tok::int as tok, hex from v")
        self.db.execute("create table merges as select a::bigint << 20 | b as pair, merged::int as merged from m")
        self.db.unregister("v")
        self.db.unregister("m")
        self.byte = np.array([ranks.get(bytes([i]), -1) for i in range(256)])
        self.apart = regex.compile(rf"(?<=[^{_SPACE}]) (?=[^{_SPACE}])").split
        self.wide = re.compile(rf"[{_SPACE}] | [{_SPACE}]").search
        self.encoded: dict[str, tuple[str, bytes]] = {}
        self.ids: dict[str, str] = {}
        self.raw: dict[str, bytes] = {}

    def learned(self, words: list[str]) -> dict[str, tuple[str, bytes]]:
        """Encode words by the recursive queries, some thousands in each."""
        raw = [(w, w.encode("utf-8", "surrogatepass")) for w in words]
        whole = [x for x in raw if len(x[1]) <= SHORT or x[1] in self.ranks]
        out = {w: got for (w, _), got in zip(whole, self._short([b for _, b in whole], True))}
        cut = {w: self.segments(b) for w, b in raw if w not in out}
        parts = sorted({p for ps in cut.values() for p in ps})
        small, large = [p for p in parts if len(p) <= SHORT], [p for p in parts if len(p) > SHORT]
        got = dict(zip(small, self._short(small, False))) | dict(zip(large, self._long(large)))
        for w, ps in cut.items():
            out[w] = " ".join([got[p][0] for p in ps]), b"".join([got[p][1] for p in ps])
        return out

    def _short(self, words: list[bytes], whole: bool) -> list[tuple[str, bytes]]:
        """whole: words that are entries keep their rank."""
        out: list = [None] * len(words)
        for s in range(0, len(words), 30_000):
            part = words[s : s + 30_000]
            self.db.register("waiting", pd.DataFrame({"word": range(len(part)), "hex": [b.hex() for b in part], "whole": whole}))
            for word, ids, text in self.db.execute(_ENCODE_SHORT).fetchall():
                out[s + word] = (ids, bytes.fromhex(text))
            self.db.unregister("waiting")
        return out

    def occurring(self, word: bytes) -> np.ndarray:
        """Rows (start, end, rank) of the entries of two bytes and more that occur in a word."""
        if self.finder is None:
            import ahocorasick

            self.finder = ahocorasick.Automaton()
            for token, rank in self.ranks.items():
                if len(token) > 1:
                    self.finder.add_word(token.decode("latin-1"), (len(token), rank))
            self.finder.make_automaton()
        found = [(end + 1 - n, end + 1, rank) for end, (n, rank) in self.finder.iter(word.decode("latin-1"))] if len(self.finder) else []
        return np.array(found, np.int64).reshape(-1, 3)

    def segments(self, word: bytes) -> list[bytes]:
        """The word cut at the borders that no occurring entry reaches across."""
        found = self.occurring(word)
        over = np.zeros(len(word) + 1, np.int64)
        np.add.at(over, found[:, 0] + 1, 1)
        np.add.at(over, found[:, 1], -1)
        cuts = [0, *(np.flatnonzero(over.cumsum()[1 : len(word)] == 0) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:])]

    def _long(self, words: list[bytes]) -> list[tuple[str, bytes]]:
        out: list = []
        held: list[bytes] = []
        for w in words:
            if held and sum(map(len, held)) + len(w) > HELD:
                out += self._contracted(held)
                held = []
            held.append(w)
        return out + (self._contracted(held) if held else [])

    def _contracted(self, words: list[bytes]) -> list[tuple[str, bytes]]:
        sizes = [len(w) for w in words]
        total = sum(sizes)
        if total > HELD:
            self.db.execute(f"set memory_limit = '{350 + 600 * total // 1_000_000}MB'")
        at = np.concatenate([np.arange(n) for n in sizes])
        byte = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        state = pd.DataFrame({"word": np.repeat(np.arange(len(words)), sizes), "s": at, "e": at + 1, "tok": byte})  # noqa: F841
        found = [self.occurring(w) for w in words]
        occ = pd.DataFrame(np.concatenate(found), columns=["s", "e", "rank"])
        occ["word"] = np.repeat(np.arange(len(words)), [len(f) for f in found])
        for name, rows in (("waiting", state), ("found", occ)):
            self.db.register(name, rows)
        self.db.execute("create or replace temp table state as select word::int as word, s::int as s, e::int as e, tok::int as tok from waiting")
        self.db.execute(f"create or replace temp table occ as select word::int as word, s::int as s, e::int as e, rank::int as rank, (s // {self.area})::int as area from found")
        self.db.unregister("waiting")
        self.db.unregister("found")
        while True:
            rows = self.db.execute("select count(*) from state").fetchone()[0]
            rounds = max(1, min(64, ROWS // max(rows, 1)))
            self.db.execute(_CONTRACT.replace("ROUNDS", str(rounds)).replace("AREA", str(self.area)))
            more = self.db.execute(f"select count(*) from after where round = {rounds}").fetchone()[0]
            self.db.execute("create or replace temp table state as select word, s, e, tok from after")
            if not more:
                break
        out: list = [None] * len(words)
        for word, ids, text in self.db.execute(_GATHER).fetchall():
            out[word] = (ids, bytes.fromhex(text))
        self.db.execute("drop table state; drop table after; drop table occ")
        if total > HELD:
            self.db.execute(f"set memory_limit = '{MEMORY}'")
        return out

    def chunks(self, text: str) -> list[str]:
        """The text cut at each single space between two other characters; the pattern never matches across. The space belongs to what follows."""
        return self.apart(text) if self.wide(text) else text.split(" ")

    def encode(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """For each text, its ids as decimal numbers joined by spaces, and the bytes they decode to."""
        chunked = [self.chunks(t) if t else [] for t in texts]
        firsts = {c[0]: self.split(c[0]) for c in chunked if c}
        words = {c: self.split(" " + c) for c in set().union(*(c[1:] for c in chunked)) - self.ids.keys()}
        fresh = self.learned(sorted(set().union(*words.values(), *firsts.values()) - self.encoded.keys()))
        for w in islice(fresh, max(0, REMEMBERED - len(self.encoded))):
            self.encoded[w] = fresh[w]
        old, new = self.encoded.get, fresh.get

        def joined(ws: list[str]) -> tuple[str, bytes]:
            if len(ws) == 1:
                return old(ws[0]) or new(ws[0])
            got = [old(w) or new(w) for w in ws]
            return " ".join([g[0] for g in got]), b"".join([g[1] for g in got])

        for c, ws in words.items():
            self.ids[c], self.raw[c] = joined(ws)
        begun = {c: joined(ws) for c, ws in firsts.items()}
        out = []
        for c in chunked:
            ids, raw = begun[c[0]] if c else ("", b"")
            if len(c) > 1:
                tail = [*map(self.ids.__getitem__, c[1:])]
                ids = " ".join([ids, *tail] if ids else tail)
                raw += b"".join(map(self.raw.__getitem__, c[1:]))
            out.append((ids, raw))
        if len(self.ids) > REMEMBERED:  # what came first is the most frequent; the newest go again
            for c in words:
                del self.ids[c], self.raw[c]
        return out


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def sliced(texts: list[str], most: int = SLICE):
    """Runs of texts of about ``most`` characters together."""
    s = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield s, i + 1
            s, size = i + 1, 0
    if s < len(texts):
        yield s, len(texts)


def encode_documents(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids (as text) of every row."""

    def work(batches):
        c = codec(ranks, pattern)
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            for a, b in sliced(texts):
                rows = []
                for doc_id, (ids, raw) in zip(pdf["doc_id"].iloc[a:b], c.encode(texts[a:b])):
                    rows.append((doc_id, ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(raw).hexdigest(), ids))
                out = pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    bounded_batches(spark)
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("ids")

"""URL filters: a bit-parallel automaton that runs all glob rules over each canonical URL at once.

A canonical URL is the host (A-Z lower-cased) followed by the path, as UTF-8 bytes. In a glob, ``*``
stands for any run of bytes without ``/``, ``**`` for any run. All patterns share one row of state
bits, packed in 64-bit words: per byte value there is a mask of positions that consume it and a mask
of wildcard positions that may stay. The batch advances one column of bytes at a time, so the state
of every URL of a batch and of all rules moves in a handful of numpy operations.

Defined cases: a null url, or one without ``://``, has an empty host and path, meets no rule and gets
the default verdict. Null page_ids pass through. Repeated rows stay repeated. A very long url is read to its
end like any other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The rules of the query, as (verdict, host, path prefix).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: What makes the globs that decide where no rule does. Words anywhere in a host that sell, cheat or farm links; how
#: labels of advert and tracking hosts begin; folders of such; endings of what is no page.
WORDS = (
    "spam casino gambl betting -bets bets- poker jackpot lottery adult porn xxx escort camgirl hentai pills viagra cialis payday -loans warez torrent cracked keygen "
    "malware phish linkfarm link-farm seo-link replica- counterfeit get-rich free-money doubleclick clickbait"
).split()
LABELS = "ads. ads- adserv adsys adtrack ad-server banner. popunder track. track- tracker tracking".split()
FOLDERS = "ads adserver banners popunder affiliates casino porn xxx warez torrents keygen phishing".split()
ENDINGS = (
    "jpg jpeg png gif bmp webp svg ico tif tiff psd mp3 mp4 avi mov mkv flv wmv wav ogg ogv webm m4a zip rar gz tgz bz2 xz 7z tar exe msi dmg iso apk jar bin dll deb rpm css js map woff woff2 ttf eot"
).split()


def _made() -> tuple:
    """The globs of those lists, some 180 patterns; with the rules they take 25 words of bits."""
    out = [f"*{w}*/**" for w in WORDS]
    out += [g for w in LABELS for g in (f"{w}*/**", f"*.{w}*/**")]
    out += [g for f in FOLDERS for g in (f"*/{f}/**", f"*/**/{f}/**")]
    out += [g for e in ENDINGS for g in (f"**.{e}", f"**.{e.upper()}")]
    return tuple(("block", g) for g in out)


GLOBS = _made()


@dataclass(frozen=True)
class Automaton:
    """Packed masks. consume[b] and stay[b]: positions entered by byte b from the left, and kept by it."""

    consume: np.ndarray
    stay: np.ndarray
    skips: np.ndarray
    start: np.ndarray
    finals: tuple

    def matches(self, urls: Sequence[bytes]) -> np.ndarray:
        """A bool matrix: URL by pattern, true where the whole URL matches."""
        n, words = len(urls), len(self.start)
        order = np.argsort([-len(u) for u in urls], kind="stable")
        lengths = np.array([len(urls[i]) for i in order], np.int64)
        flat = np.frombuffer(b"".join(urls[i] for i in order) + b"\0", np.uint8)
        at = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if n else np.zeros(0, np.int64)
        state = np.repeat(self._closed(self.start[None, :]), n, 0)
        for col in range(int(lengths[0]) if n else 0):
            live = int(np.searchsorted(-lengths, -col, "left"))
            byte = flat[at[:live] + col]
            s = state[:live]
            state[:live] = self._closed((_shifted(s) & self.consume[byte]) | (s & self.stay[byte]))
        out = np.zeros((n, len(self.finals)), bool)
        for k, p in enumerate(self.finals):
            out[order, k] = (state[:, p // 64] >> np.uint64(p % 64)) & np.uint64(1) == 1
        assert state.shape[1] == words
        return out

    def _closed(self, s: np.ndarray) -> np.ndarray:
        """Wildcards may match nothing: a state before one is also a state at it."""
        while True:
            more = s | (_shifted(s) & self.skips)
            if (more == s).all():
                return s
            s = more


def _shifted(s: np.ndarray) -> np.ndarray:
    """Every bit one position up, carried across words."""
    out = s << np.uint64(1)
    out[:, 1:] |= s[:, :-1] >> np.uint64(63)
    return out


def compiled(globs: Sequence[str]) -> Automaton:
    """Pack globs into one automaton. A pattern of m items takes m + 1 bits: before all, and after each."""
    plan: list[tuple[int, object]] = []
    starts, finals = [], []
    for g in globs:
        raw, items, i = g.encode(), [], 0
        while i < len(raw):
            if raw[i : i + 2] == b"**":
                items.append("any")
                i += 2
            elif raw[i : i + 1] == b"*":
                items.append("label")
                i += 1
            else:
                items.append(raw[i])
                i += 1
        starts.append(len(plan))
        plan.append((len(plan), None))
        for item in items:
            plan.append((len(plan), item))
        finals.append(len(plan) - 1)
    words = len(plan) // 64 + 1
    consume, stay = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64)
    skips, start = np.zeros(words, np.uint64), np.zeros(words, np.uint64)
    for p, item in plan:
        w, bit = p // 64, np.uint64(1) << np.uint64(p % 64)
        if isinstance(item, int):
            consume[item, w] |= bit
        elif item is not None:
            skips[w] |= bit
            for b in range(256):
                if item == "any" or b != 47:
                    stay[b, w] |= bit
    for p in starts:
        start[p // 64] |= np.uint64(1) << np.uint64(p % 64)
    return Automaton(consume, stay, skips, start, tuple(finals))


def canonical() -> tuple:
    """Host and path columns of a url column."""
    url = F.coalesce(F.col("url"), F.lit(""))
    has = F.instr(url, "://") > 0
    rest = F.expr("substring(coalesce(url, ''), instr(coalesce(url, ''), '://') + 3)")
    host = F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise("").alias("host"), F.when(has, path).otherwise("").alias("path")


def filter_urls(pages: DataFrame, rules=RULES, globs=GLOBS, default: str = "allow") -> DataFrame:
    """page_id, url, host, path, rule, verdict. The longest fitting rule decides, then the globs, then the default."""
    patterns: list[str] = []
    for _, host, path in rules:
        patterns += [f"{host}{path}**", f"*.{host}{path}**"]
    machine = compiled([*patterns, *(g for _, g in globs)])
    names = [h + p for _, h, p in rules]
    order = sorted(range(len(rules)), key=lambda k: len(names[k]))

    def judge(batches):
        for pdf in batches:
            urls = [(h + p).encode("utf-8", "surrogatepass") for h, p in zip(pdf["host"], pdf["path"])]
            hit = machine.matches(urls)
            rule = np.full(len(urls), None, object)
            verdict = np.full(len(urls), default, object)
            for k, (v, _) in reversed(list(enumerate(globs))):
                verdict[hit[:, 2 * len(rules) + k]] = v
            for k in order:
                fits = hit[:, 2 * k] | hit[:, 2 * k + 1]
                rule[fits], verdict[fits] = names[k], rules[k][0]
            pdf["rule"], pdf["verdict"] = rule, verdict
            yield pdf

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", *canonical())
    return rows.mapInPandas(judge, "page_id long, url string, host string, path string, rule string, verdict string")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


#: The same rows in SQL.
_ANY = lambda column, words: " or ".join(f"contains({column}, '{w}')" for w in words)
_LISTED = (
    f"starts_with(path, '/') and ({_ANY('host', WORDS)} or " + " or ".join(f"starts_with(host, '{w}')" for w in LABELS) + f" or {_ANY('host', ['.' + w for w in LABELS])}) "
    f"or {_ANY('path', [f'/{f}/' for f in FOLDERS])} or regexp_matches(host || path, '\\.({'|'.join([*ENDINGS, *(e.upper() for e in ENDINGS)])})$')"
)
OP6_SQL = rf"""
with u as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), h as (
  select page_id, translate(regexp_extract(rest, '(?s)\A([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '(?s)\A[^/?#]*([^?#]*)', 1) as path from u
), r as (
  select *, case
    when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule from h
)
select page_id, host, path, rule, case
    when rule in ('example.net/en/', 'org/fr/') then 'allow'
    when rule is not null then 'block'
    when {_LISTED} then 'block'
    else 'allow' end as verdict
from r
"""

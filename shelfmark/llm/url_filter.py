"""URL filters on a sorted digest array.

The rules (host, path, verdict) become one file: their 64-bit xxhash keys in sorted order, then the full strings. Spark
ships the file to every executor, where it is memory-mapped; a batch of addresses is probed by one vectorised binary
search, and each hit is confirmed against the stored string, so equal digests of different strings do no harm. Pages
are never shuffled.

Defined results: a null address, or one without `://`, has an empty host and path and meets no rule. Without rules
nothing is blocked. Repeated rules count once; of rules that differ in verdict only, `block` stands. Repeated rows are
judged one by one. Other columns of the input than the id and the address are not returned, so their names are free.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A rule list is configuration that is shipped to every executor. Beyond this the builder stops with an error; split
#: such a list and keep the longer of the rules found by each part.
MAX_ARRAY_BYTES = 1 << 30

Rule = tuple[str, str, str]


def host_and_path(url):
    """Columns host and path: the host after the first `://` with A-Z lower-cased, the path up to `?` or `#`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substring(rest, F.length(host) + 1, F.length(rest) + 1)
    path = F.regexp_extract(after, r"^[^?#]*", 0)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(low, F.lit("")), F.coalesce(path, F.lit(""))


def entry_key(host: str, path: str) -> bytes:
    """The string that stands for a rule; the length of the host keeps different splits apart."""
    return f"{len(host)}:{host}{path}".encode("utf-8", "surrogatepass")


def digests(keys: Iterable[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), dtype=np.uint64)


def write_array(rules: Iterable[Rule], path: str, digest=digests) -> None:
    """Write the sorted digest array: a header, host digests, path lengths, keys, verdicts, offsets, strings."""
    chosen: dict[bytes, str] = {}
    hosts, lengths, total = set(), set(), 0
    for host, prefix, verdict in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"verdict {verdict!r}")
        key = entry_key(host, prefix)
        if key not in chosen:
            total += len(key) + 25
            if total > MAX_ARRAY_BYTES:
                raise ValueError("the rule list is too large for one array; split it")
            chosen[key] = verdict
        elif verdict == "block":
            chosen[key] = verdict
        hosts.add(host.encode("utf-8", "surrogatepass"))
        lengths.add(len(prefix))
    strings = list(chosen)
    keys = digest(strings)
    order = np.argsort(keys, kind="stable")
    sizes = np.array([len(strings[i]) for i in order], dtype=np.int64)
    host_keys = np.sort(digest(hosts))
    parts = [
        np.array([len(host_keys), len(lengths), len(order)], dtype=np.int64), host_keys,
        np.array(sorted(lengths), dtype=np.int64), keys[order], np.concatenate(([0], np.cumsum(sizes))).astype(np.int64),
        np.array([chosen[strings[i]] == "block" for i in order], dtype=np.uint8)]
    with open(path, "wb") as out:
        for part in parts:
            out.write(part.tobytes())
        for i in order:
            out.write(strings[i])


class DigestArray:
    """The memory-mapped file."""

    def __init__(self, path: str, digest=digests):
        data = np.memmap(path, dtype=np.uint8, mode="r")
        n_hosts, n_lengths, n = (int(x) for x in data[:24].view(np.int64))
        at, self.digest = 24, digest

        def take(count, kind):
            nonlocal at
            start, at = at, at + count * np.dtype(kind).itemsize
            return data[start:at].view(kind)

        self.hosts, self.lengths, self.keys = take(n_hosts, np.uint64), take(n_lengths, np.int64).tolist(), take(n, np.uint64)
        self.offsets = take(n + 1, np.int64)
        self.blocked = take(n, np.uint8)
        self.strings = data[at:]

    def known_hosts(self, hosts: list[bytes]) -> np.ndarray:
        """Whether the digest of each host is that of some rule's host; rules are confirmed later."""
        found = self.digest(hosts)
        at = np.searchsorted(self.hosts, found)
        return (at < len(self.hosts)) & (self.hosts[np.minimum(at, len(self.hosts) - 1)] == found)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The position of each string, or -1."""
        wanted = self.digest(keys)
        first, last = np.searchsorted(self.keys, wanted, "left"), np.searchsorted(self.keys, wanted, "right")
        out = np.full(len(keys), -1, dtype=np.int64)
        for i in np.flatnonzero(last > first):
            for j in range(first[i], last[i]):
                if self.strings[self.offsets[j]:self.offsets[j + 1]].tobytes() == keys[i]:
                    out[i] = j
                    break
        return out


def judge(array: DigestArray, hosts: list[str], paths: list[str]) -> list[tuple[str, str] | None]:
    """For each address the longest rule that fits and its verdict; of equally long ones that with the longer host."""
    if not len(array.keys):
        return [None] * len(hosts)
    suffixes: dict[str, list[str]] = {}
    for host in set(hosts):
        labels = host.split(".")
        suffixes[host] = [".".join(labels[i:]) for i in range(len(labels))]
    names = list({s for found in suffixes.values() for s in found})
    known = {n for n, hit in zip(names, array.known_hosts([n.encode("utf-8", "surrogatepass") for n in names])) if hit}
    suffixes = {host: [s for s in found if s in known] for host, found in suffixes.items()}
    owners, texts, keys = [], [], []
    for i, (host, path) in enumerate(zip(hosts, paths)):
        for suffix in suffixes[host]:
            for n in array.lengths:
                if n > len(path):
                    break
                owners.append(i)
                texts.append((suffix, path[:n]))
                keys.append(entry_key(suffix, path[:n]))
    best: list[tuple | None] = [None] * len(hosts)
    if keys:
        at = array.find(keys)
        for j in np.flatnonzero(at >= 0):
            host, prefix = texts[j]
            rank = (len(host) + len(prefix), len(host), host + prefix, "block" if array.blocked[at[j]] else "allow")
            if best[owners[j]] is None or rank[:2] > best[owners[j]][:2]:
                best[owners[j]] = rank
    return [None if b is None else (b[2], b[3]) for b in best]


def ship(spark, rules: Iterable[Rule]) -> str:
    """Write the array and have Spark send it to all executors, also to those that join later; its file name."""
    handle, path = tempfile.mkstemp(prefix="digests-")
    os.close(handle)
    write_array(rules, path)
    with open(path, "rb") as f:
        name = f"digests-{hashlib.sha256(f.read()).hexdigest()[:24]}.bin"
    folder = tempfile.mkdtemp(prefix="rules-")
    os.rename(path, os.path.join(folder, name))
    if not any(x.endswith("/" + name) for x in spark.sparkContext.listFiles):
        spark.sparkContext.addFile(os.path.join(folder, name))
    return name


def filter_urls(pages: DataFrame, rules: Iterable[Rule] | DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule (host and path of the longest rule that fits, else null) and verdict of every row.

    A rule fits its host and all subdomains if the path starts with the rule's. Where none fits the verdict is `allow`:
    the address is not in the array. Rules come as (host, path, verdict), in a list or a DataFrame.
    """
    if isinstance(rules, DataFrame):
        rules = ((r["host"], r["path"], r["verdict"]) for r in rules.select("host", "path", "verdict").dropna().toLocalIterator())
    name = ship(pages.sparkSession, rules)
    host, path = host_and_path(F.col(url_col))
    narrow = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    schema = f"`{id_col}` {narrow.schema[0].dataType.simpleString()}, host string, path string, rule string, verdict string"

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(SparkFiles.get(name))
        for batch in batches:
            found = judge(array, batch.column(1).to_pylist(), batch.column(2).to_pylist())
            rule = pa.array([None if f is None else f[0] for f in found], pa.string())
            verdict = pa.array(["allow" if f is None else f[1] for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], [id_col, "host", "path", "rule", "verdict"])

    return narrow.mapInArrow(probe, schema)

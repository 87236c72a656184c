"""Plain Python versions of the corpus operators, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re


def lower_ascii(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def contamination(docs, items, window=13):
    """[(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)] of (id, text) pairs."""

    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(text or ""))

    wins = {}
    for item, text in items:
        w = words(text)
        if item is None or not w:
            continue
        size = min(window, len(w))
        for i in range(len(w) - size + 1):
            wins.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    sizes = {len(w) for w in wins}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (key := tuple(w[i : i + size])) in wins:
                    hit.update(range(i, i + size))
                    found |= wins[key]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        bad = bool(hit) and 20 * len(hit) >= len(w)
        out.append((doc, len(w), len(hit), len(found), digest, bad))
    return out


def quality_base(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    repeated = {p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(repeated) > 30 * len(w)
    n_symbols = sum(c in "#*$%&|<>" for c in text)
    return len(w), sum(map(len, w)), n_symbols, len(lines) - len(set(lines)), len(repeated), failed


def fingerprint(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_components(docs, max_bits=3):
    """[(doc_id, fingerprint, component_id)]; compares all pairs of distinct fingerprints."""
    fps = {doc: fingerprint(text) for doc, text in docs}
    distinct = sorted(set(fps.values()))
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, f in enumerate(distinct):
        for g in distinct[i + 1 :]:
            if (f ^ g).bit_count() <= max_bits:
                root[find(f)] = find(g)
    first = {}
    for doc, f in fps.items():
        first[find(f)] = min(first.get(find(f), doc), doc)
    return [(doc, f"{f:016x}", first[find(f)]) for doc, f in fps.items()]


def licenses(docs, templates, shingle=5, least=0.8):
    """{(doc_id, license): (best containment, start, end)} over all windows, at every place."""

    def words(text):
        return re.findall(r"[^\W_]+", (text or "").lower())

    def versions(want):
        name = "(^| )(version|license|licence|v|by|sa|nc|nd|gpl|lgpl|agpl|mpl|epl) [0-9]+"
        for behind in (" [^ ]", "$"):
            found = {s for s in want if re.search(name + behind, " ".join(s))}
            if found:
                return found
        return set()

    prepared = []
    for name, template in templates:
        t = words(template)
        k = min(shingle, len(t))
        if name is not None and t:
            want = {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}
            prepared.append((name, len(t), k, want, versions(want)))
    out = {}
    for doc, text in docs:
        w = words(text)
        every = {k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] for k in range(1, shingle + 1)}
        sets = {k: set(x) for k, x in every.items()}
        best = {}
        for name, length, k, want, must in prepared:
            if len(sets[k] & want) < least * len(want):
                continue
            step = max(1, length // 8)
            for start in range(0, max(1, len(w)), step):
                part = every[k][start : start + length + step - k]
                have = set(part) & want
                if len(have) >= least * len(want) and 2 * len(have & must) >= len(must):
                    hit = [start + i for i, s in enumerate(part) if s in want]
                    rank = (-len(have) / len(want), -len(have), hit[0], hit[-1] + k)
                    best[name] = min(best.get(name, rank), rank)
        for name, (less, fewer, a, b) in best.items():
            if not any(n != name and f < fewer and x <= a and y >= b for n, (_, f, x, y) in best.items()):
                out[doc, name] = (-less, a, b)
    return out


def _runs(text, least):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + least]) for i in range(len(w) - least + 1)}


def sharing_with_earlier(docs, least):
    """Documents with ``least`` words in a row that an earlier one of ``docs`` (sorted) has."""
    seen, out = set(), set()
    for doc, text in docs:
        runs = _runs(text, least)
        if runs & seen:
            out.add(doc)
        seen |= runs
    return out


def secret_base(text):
    text = text or ""
    assign = re.compile(
        r"(?a)((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    )
    spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    n_assign = len(spans)
    for rank, pattern, least in ((1, r"AKIA[A-Z0-9]+", 20), (2, r"[0-9a-f]+", 24)):
        found = re.finditer(pattern, text)
        spans += [(m.start(), rank, m.end()) for m in found if len(m[0]) >= least]
    names = ("assign", "access", "hex")
    joined = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(spans))
    counts = [sum(k == i for _, k, _ in spans) for i in (1, 2)]
    return n_assign, *counts, hashlib.sha256(joined.encode()).hexdigest()


def without_earlier_runs(docs, least):
    """{doc_id: words} without those in a run of ``least`` words of an earlier one of ``docs`` (sorted)."""
    seen, out = set(), {}
    for doc, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = [tuple(w[i : i + least]) for i in range(len(w) - least + 1)]
        covered = {k for i, x in enumerate(runs) if x in seen for k in range(i, i + least)}
        out[doc] = [x for k, x in enumerate(w) if k not in covered]
        seen.update(runs)
    return out

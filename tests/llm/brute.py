"""Plain Python versions of the operators, straight from their definitions, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
BLANKS = " \t\n\v\f\r"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    windows = Counter(tuple(words[i : i + 5]) for i in range(n - 4))
    hit = {i + k for i in range(n - 4) for k in range(5) if windows[tuple(words[i : i + 5])] > 1}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = n < 10 or 100 * len(hit) > 20 * n
    return n, sum(map(len, words)), len(SYMBOL.findall(text)), len(lines) - len(set(lines)), len(hit), failed


FURNITURE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use cookies", "uses cookies", "enable javascript", "click here", "read more",
    "skip to content", "skip to main content", "sign in", "sign up", "login", "log in", "subscribe now", "subscribe to", "share this", "share on", "powered by",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerkl\u00e4rung", "impressum", "verwendet cookies", "mehr lesen", "weiterlesen", "jetzt anmelden",
    "tous droits r\u00e9serv\u00e9s", "conditions d'utilisation", "mentions l\u00e9gales", "utilise des cookies", "lire la suite", "en savoir plus", "se connecter",
    "todos los derechos reservados", "aviso legal", "utiliza cookies", "leer m\u00e1s", "iniciar sesi\u00f3n", "suscr\u00edbete",
)


def line_fails(line):
    """The line rules, character by character."""
    bare = line.strip(BLANKS)
    if not bare:
        return False
    words = WORD.findall(bare)
    symbols = sum(c in "#*$%&|<>" for c in bare)
    if symbols and 10 * symbols >= sum(map(len, words)):
        return True
    bars = sum(c in "|\u00bb\u203a\u2022\u00b7" for c in bare)
    if bars >= 3 and len(words) <= 4 * bars + 3:
        return True
    shouts = bare.count("!")
    if shouts >= 3 and 2 * shouts >= len(words):
        return True
    if len(words) <= 3 and bare[-1] not in ".!?:;\u2026\"'\u201d\u2019\u00bb)]\u3002\uff01\uff1f":
        item = (bare[0] in "-*\u2022\u2013" and bare[1:2] in (" ", "\t")) or re.match("[0-9]+[.)][ \t]", bare)
        run = best = 0
        for c in bare:
            run = run + 1 if 0x2E80 <= ord(c) <= 0x9FFF or 0xAC00 <= ord(c) <= 0xD7AF else 0
            best = max(best, run)
        if not item and best < 4:
            return True
    low, word = bare.lower(), lambda c: c.isascii() and (c.isalnum() or c == "_")
    for phrase in FURNITURE:
        at = low.find(phrase)
        while at >= 0:
            end = at + len(phrase)
            if (at == 0 or not word(low[at - 1])) and (end == len(low) or not word(low[end])):
                return True
            at = low.find(phrase, at + 1)
    return False


def quality_kept(text):
    lines = (text or "").split("\n")
    size = lambda x: len(x.strip(BLANKS))
    lost = sum(size(x) for x in lines if line_fails(x))
    return not quality(text)[-1] and lost <= 0.5 * sum(map(size, lines)), "\n".join(x for x in lines if not line_fails(x))


def line_dedup(rows, min_chars=10):
    key = lambda line: lower(line.strip(BLANKS))
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(key(x)) < min_chars or len(holders[key(x)]) < 2 or min(holders[key(x)]) == doc]
        out.append((doc, len(lines), len(lines) - len(stay), sha("\n".join(stay))))
    return out


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def decontaminate(docs, items, size=10):
    windows = {}
    for name, text in items:
        words = bench_words(text)
        step = min(size, len(words))
        for i in range(len(words) - step + 1) if words else ():
            windows.setdefault(tuple(words[i : i + step]), set()).add(name)
    sizes = sorted({len(w) for w in windows})
    out = []
    for doc, text in docs:
        words = bench_words(text)
        hit, names = set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                found = windows.get(tuple(words[i : i + n]))
                if found is not None:
                    hit.update(range(i, i + n))
                    names |= {str(x) for x in found if x is not None}
        out.append((doc, len(words), len(hit), len(names), sha(",".join(sorted(names))), bool(hit)))
    return out


def fingerprint(text, width=3):
    words = WORD.findall(lower(text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(docs, prints, limit=2):
    n = len(docs)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= limit:
                root[find(i)] = find(j)
    least = {}
    for i in range(n):
        if docs[i] is not None:
            least[find(i)] = min(docs[i], least.get(find(i), docs[i]))
    return [(docs[i], f"{prints[i]:016x}", least.get(find(i))) for i in range(n)]


def secrets(text):
    text, found = text or "", []
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found += [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    named = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))
    counts = Counter(k for _, k, _ in found)
    return counts[0], counts[1], counts[2], sha(named), named


def held(doc, folds, fold):
    return doc is not None and zlib.crc32(str(doc).encode()) % folds == fold


def word_unigram(docs):
    tokens = {k: [*WORD.findall(lower(text or "")), None] for k, (_, text) in enumerate(docs)}
    counts = Counter(t for k, ts in tokens.items() if not held(docs[k][0], 5, 1) for t in ts)
    total, kinds = sum(counts.values()), len(counts)
    score = lambda t: math.log10((counts[t] + 0.5) / (total + 0.5 * (kinds + 1)))
    return [
        (doc, held(doc, 5, 1), len(tokens[k]), sum(counts[t] > 0 for t in tokens[k]), total, math.fsum(map(score, tokens[k])))
        for k, (doc, _) in enumerate(docs)
    ]


def water_fill(sizes, weights, share, most):
    """Targets by the loop of the definition: clamp, hand out the rest by weight, again."""
    target = dict.fromkeys(sizes, 0.0)
    left, clamped = share * sum(sizes.values()), set()
    while True:
        open_ = [s for s in sizes if s not in clamped]
        level = left / sum(weights[s] for s in open_) if open_ else 0
        over = [s for s in open_ if weights[s] * level > most * sizes[s]]
        if not over:
            for s in open_:
                target[s] = weights[s] * level
            return target
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
            clamped.add(s)

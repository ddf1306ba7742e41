"""Full-text search: tsvectors and tsqueries as text, in Arrow UDFs.

A document becomes lexemes with positions: words lower-cased, stop words dropped, suffixes stripped by a small Porter-style stemmer.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

#: The common English stop words.
STOP = frozenset("a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor not now of off on once only or other our ours out over own s same she should so some such t than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with you your".split())
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")


@lru_cache(maxsize=1 << 17)
def stem(w: str) -> str:
    """A word without its inflexion."""
    if len(w) <= 3:
        return w
    for suffix, put in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(suffix):
            w = w[: len(w) - len(suffix)] + put
            break
    vowel = lambda x: re.search(r"[aeiouy]", x)
    for suffix in ("eed", "ed", "ing"):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if suffix == "eed":
                w = base + "ee" if vowel(base) else w
            elif vowel(base):
                w = base
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "lsz":
                    w = w[:-1]
            break
    if w.endswith("y") and len(w) > 2 and vowel(w[:-1]):
        w = w[:-1] + "i"
    for suffix, put in (("ational", "ate"), ("ization", "ize"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("ement", ""), ("ment", ""), ("ness", ""), ("ation", "ate"), ("alli", "al"), ("ence", ""), ("ance", ""), ("able", ""), ("ible", ""), ("ful", ""), ("ous", ""), ("ive", ""), ("ize", ""), ("er", ""), ("ion", ""), ("al", "")):
        if w.endswith(suffix) and len(w) - len(suffix) > 3:
            w = w[: len(w) - len(suffix)] + put
            break
    return w[:-1] if w.endswith("e") and len(w) > 4 else w


def lexemes(text: str, config: str = "english") -> list[tuple[str, int]]:
    """(lexeme, position from 1), stop words keeping their place."""
    out = []
    for k, m in enumerate(_WORD.finditer(text), 1):
        w = m[0].lower()
        if config == "simple":
            out.append((w, k))
        elif w not in STOP:
            out.append((stem(w), k))
    return out


def vector(pairs) -> str:
    at: dict[str, list[int]] = {}
    for w, k in pairs:
        at.setdefault(w, []).append(k)
    return " ".join(f"'{w}':{','.join(map(str, at[w]))}" for w in sorted(at))


def parse_vector(s: str) -> dict[str, list[tuple[int, str]]]:
    return {m[1]: [(int(x.rstrip("ABCD")), x[-1] if x[-1] in "ABC" else "D") for x in m[2].split(",")] if m[2] else [] for m in re.finditer(r"'([^']*)'(?::([\dA-D,]+))?", s)}


def plain_query(text: str, joint: str = " & ", config: str = "english") -> str:
    return joint.join(f"'{w}'" for w, _ in lexemes(text, config))


def web_query(text: str, config: str = "english") -> str:
    out: list[str] = []
    for m in re.finditer(r'(-?)"([^"]*)"|(-?)(\S+)', text):
        neg, words = (m[1], m[2]) if m[2] is not None else (m[3], m[4])
        if words.lower() == "or" and m[2] is None:
            out.append("|")
            continue
        q = plain_query(words, " <-> ", config)
        if q:
            if out and out[-1] not in ("|",):
                out.append("&")
            out.append(("!" if neg else "") + (f"( {q} )" if neg and "<->" in q else q))
    return " ".join(out).strip("| ")


def to_query(text: str, config: str = "english") -> str:
    return re.sub(r"'([^']*)'|([^\W_]+)(:\*)?", lambda m: f"'{m[1] if m[1] is not None else (m[2].lower() if config == 'simple' else stem(m[2].lower()))}'{m[3] or ''}", text)


@lru_cache(maxsize=256)
def parse_query(q: str):
    """A tree of ('lex', w, prefix), ('!', x), ('&', x, y), ('|', x, y), ('<n>', x, y)."""
    tokens = re.findall(r"'[^']*'(?::\*)?|<->|<\d+>|[&|!()]", q)
    at = 0

    def atom():
        nonlocal at
        if at >= len(tokens):
            return None
        t = tokens[at]
        at += 1
        if t == "!":
            return ("!", atom())
        if t == "(":
            x = either()
            at += 1
            return x
        return ("lex", t.split("'")[1], t.endswith(":*"))

    def phrase():
        nonlocal at
        x = atom()
        while at < len(tokens) and tokens[at].startswith("<"):
            n = 1 if tokens[at] == "<->" else int(tokens[at][1:-1])
            at += 1
            x = (f"<{n}>", x, atom())
        return x

    def both():
        nonlocal at
        x = phrase()
        while at < len(tokens) and tokens[at] == "&":
            at += 1
            x = ("&", x, phrase())
        return x

    def either():
        nonlocal at
        x = both()
        while at < len(tokens) and tokens[at] == "|":
            at += 1
            x = ("|", x, both())
        return x

    return either()


def _places(tree, v) -> set[int]:
    if tree[0] == "lex":
        return {k for w, ps in v.items() if w == tree[1] or tree[2] and w.startswith(tree[1]) for k, _ in ps}
    if tree[0].startswith("<"):
        n, b = int(tree[0][1:-1]), _places(tree[2], v)
        return {k + n for k in _places(tree[1], v) if k + n in b}
    return _places(tree[1], v) | _places(tree[2], v) if tree[0] in "&|" else set()


def matches(v: dict, tree) -> bool:
    if tree is None:
        return False
    if tree[0] == "lex":
        return any(w == tree[1] or tree[2] and w.startswith(tree[1]) for w in v)
    if tree[0] == "!":
        return not matches(v, tree[1])
    if tree[0] == "&":
        return matches(v, tree[1]) and matches(v, tree[2])
    if tree[0] == "|":
        return matches(v, tree[1]) or matches(v, tree[2])
    return bool(_places(tree, v))


def _words(tree) -> list[tuple[str, bool]]:
    if tree is None or tree[0] == "!":
        return []
    return [(tree[1], tree[2])] if tree[0] == "lex" else _words(tree[1]) + _words(tree[2])


_WEIGHT = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}


def text_rank(text: str, q: str, config: str = "english") -> float | None:
    """The rank of a text that matches, else None; positions are kept for the query's words alone."""
    tree = parse_query(q)
    words = _every(tree)
    whole, heads = {w for w, p in words if not p}, tuple(w for w, p in words if p)
    v: dict[str, list[tuple[int, str]]] = {}
    for k, m in enumerate(_WORD.finditer(text.lower()), 1):
        w = m[0]
        if config != "simple":
            if w in STOP:
                continue
            w = stem(w)
        if w in whole or heads and w.startswith(heads):
            v.setdefault(w, []).append((k, "D"))
    return _rank(v, tree) if matches(v, tree) else None


def _every(tree) -> list[tuple[str, bool]]:
    """All words of a query, negated ones too."""
    if tree is None:
        return []
    return [(tree[1], tree[2])] if tree[0] == "lex" else [w for x in tree[1:] for w in _every(x)]


def rank(s: str, q: str) -> float:
    v, tree = parse_vector(s), parse_query(q)
    return _rank(v, tree) if matches(v, tree) else 0.0


def _rank(v: dict, tree) -> float:
    """Each query word adds its occurrences' weights, falling with the square of their order, over the number of words."""
    words = _words(tree)
    total = 0.0
    for w, prefix in words:
        weights = sorted((_WEIGHT[c] for x, ps in v.items() if x == w or prefix and x.startswith(w) for _, c in ps), reverse=True)
        total += sum(x / (k * k) for k, x in enumerate(weights, 1)) / 1.64493406685
    return total / len(words) if words else 0.0


def rank_cd(s: str, q: str) -> float:
    """Cover density: every shortest span that holds all query words adds 0.1 over its length."""
    v, words = parse_vector(s), _words(parse_query(q))
    at = sorted((k, i) for i, (w, p) in enumerate(words) for x, ps in v.items() if x == w or p and x.startswith(w) for k, _ in ps)
    total, seen = 0.0, {}
    for k, i in at:
        seen[i] = k
        if len(seen) == len(words):
            lo = min(seen.values())
            total += 0.1 / max(1, k - lo + 1 - (len(words) - 1))
            seen = {j: p for j, p in seen.items() if p > lo}
    return total


def headline(text: str, q: str) -> str:
    words = _words(parse_query(q))
    hit = lambda w: any(stem(w.lower()) == x or w.lower() == x or p and w.lower().startswith(x) for x, p in words)
    return _WORD.sub(lambda m: f"<b>{m[0]}</b>" if hit(m[0]) else m[0], text)


def _two(name):
    """name([config,] text)"""
    return lambda a, b=None: f"{name}({b}, {a})" if b is not None else f"{name}({a}, 'english')"


MACROS = {
    "to_tsvector": _two("pm_to_tsvector"), "to_tsquery": _two("pm_to_tsquery"), "plainto_tsquery": _two("pm_plainto_tsquery"), "phraseto_tsquery": _two("pm_phraseto_tsquery"), "websearch_to_tsquery": _two("pm_websearch_to_tsquery"),
    "ts_rank": lambda v, q, *_: f"pm_ts_rank({v}, {q})", "ts_rank_cd": lambda v, q, *_: f"pm_ts_rank_cd({v}, {q})", "ts_headline": lambda *a: f"pm_ts_headline({a[-2]}, {a[-1]})" if len(a) == 2 or a[0].startswith(("'english", "'simple")) else f"pm_ts_headline({a[0]}, {a[1]})",
    "ts_lexize": lambda d, w: f"pm_ts_lexize({w})", "ts_match": lambda v, q: f"pm_ts_match({v}, {q})", "strip": lambda v: f"regexp_replace({v}, ':[0-9A-D,]+', '')", "tsvector_to_array": lambda v: f"regexp_extract_all({v}, '\\'([^\\']*)\\'', 1)", "array_to_tsvector": lambda a: f"array_join(transform(array_sort(array_distinct({a})), x -> concat('\\'', x, '\\'')), ' ')",
    "numnode": lambda q: f"regexp_count({q}, '\\'[^\\']*\\'|[&|!]|<[-0-9]+>')", "setweight": lambda v, w: f"regexp_replace({v}, '([0-9]+)[A-D]?', concat('$1', {w}))", "tsquery_phrase": lambda a, b, n=None: f"concat({a}, ' <', {n or chr(39) + '-' + chr(39)}, '> ', {b})", "ts_delete": lambda v, w: f"pm_ts_delete({v}, {w if w.startswith('array') else f'array({w})'})", "ts_filter": lambda v, w: f"pm_ts_filter({v}, {w})", "tsquery": lambda q: q,
    "json_to_tsvector": lambda *a: f"pm_to_tsvector(pm_json_strings({a[0] if len(a) == 2 else a[1]}), 'english')", "jsonb_to_tsvector": lambda *a: f"pm_to_tsvector(pm_json_strings({a[0] if len(a) == 2 else a[1]}), 'english')", "ts_rewrite": lambda q, a, b: f"replace({q}, {a}, concat('( ', {b}, ' )'))",
}


def udfs():
    from ._udf import elementwise

    return {
        "pm_to_tsvector": elementwise(lambda s, c: vector(lexemes(s, c)), "string"), "pm_to_tsquery": elementwise(to_query, "string"), "pm_plainto_tsquery": elementwise(lambda s, c: plain_query(s, " & ", c), "string"), "pm_phraseto_tsquery": elementwise(lambda s, c: plain_query(s, " <-> ", c), "string"), "pm_websearch_to_tsquery": elementwise(web_query, "string"),
        "pm_ts_match": elementwise(lambda v, q: matches(parse_vector(v), parse_query(q)), "boolean"), "pm_ts_rank": elementwise(rank, "double"), "pm_ts_rank_cd": elementwise(rank_cd, "double"), "pm_text_rank": elementwise(text_rank, "double"), "pm_ts_headline": elementwise(headline, "string"), "pm_ts_lexize": elementwise(lambda w: [] if w.lower() in STOP else [stem(w.lower())], "array<string>"),
        "pm_ts_delete": elementwise(lambda v, ws: " ".join(m[0] for m in re.finditer(r"'([^']*)'(?::[\dA-D,]+)?", v) if m[1] not in set(ws)), "string"), "pm_ts_filter": elementwise(lambda v, ws: " ".join(f"'{w}':{','.join(str(k) + (c if c != 'D' else '') for k, c in ps if c.lower() in set(ws))}" for w, ps in parse_vector(v).items() if any(c.lower() in set(ws) for _, c in ps)), "string"),
    }


def bm25_idf(n_docs: float, n_with: float) -> float:
    return math.log(1 + (n_docs - n_with + 0.5) / (n_with + 0.5))

"""Lexer, features and a linear-chain conditional random field that label the characters of literal secrets.

Labels are O, B (first token of a secret) and I (further tokens). The model is trained once in a process, on lines that
``secret_samples`` writes from templates with a fixed seed. B is open only to tokens of candidate atoms and of users in
addresses; every line is cut into tokens, and one without an open token, which has no path through B, is left at O.
"""

from __future__ import annotations

import base64
import binascii
import re
from functools import lru_cache

import numpy as np

# Public prefixes of issued credentials.
PREFIXES = (
    "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "gldt-", "glrt-", "AKIA", "ASIA", "AIza", "sk_live_", "sk_test_", "rk_live_", "rk_test_",
    "whsec_", "xoxb-", "xoxp-", "xoxa-", "xoxs-", "xoxr-", "xapp-", "npm_", "pypi-", "SG.", "eyJ", "sk-", "dop_v1_", "doo_v1_", "hf_", "ya29.",
    "shpat_", "shpss_", "dckr_pat_", "hvs.", "hvb.", "lin_api_", "sntrys_", "sq0atp-", "sq0csp-", "EAAC", "AGE-SECRET-KEY-", "PMAK-", "figd_", "NRAK-", "rubygems_", "tfp_", "ATATT", "ATCTT",
)
_PREFIX = re.compile("(?:" + "|".join(map(re.escape, PREFIXES)) + ")")
#: Words in a name that speak for a credential, and against one.
CRED = frozenset(
    "password passwd passw pass pwd passphrase passcode pw secret secrets token tokens key keys apikey api credential credentials cred creds auth authorization bearer basic login private signing hmac"
    " access refresh client service dsn psk otp pin salt session cookie sig signature encryption jwt oauth webhook admin root smtp db".split()
)
STRONG = frozenset("password passwd pass pwd passphrase secret token apikey credential cred bearer authorization psk".split())
AGAINST = frozenset(
    "sha sha1 sha256 sha384 sha512 md5 checksum digest hash hashes fingerprint integrity commit rev revision etag uuid guid id ids run public pub verify label hint prompt message title pattern regex"
    " example sample placeholder ttl seconds timeout length size count max min name names field column header url uri path file icon image img png svg logo color version build tag ref checksums base"
    " expected pinned parent tree blob object nonce trace request correlation help text description error type kind class style selector".split()
)
_PLACEHOLDER = re.compile(
    r"change[-_ ]?(?:me|it|this)|replace[-_ ]?(?:me|this|with)?|your[-_ ]|<[^<>]*>|example|placeholder|dummy|fake|redacted|masked|hidden|removed|todo|fixme|insert|enter[-_ ]|fill[-_ ]?in|sample|not[-_ ]?(?:a[-_ ])?(?:real|set|used|secret)|none|null|undefined|n/a|secret[-_ ]?here|here$|my[-_](?:secret|token|password|key)|^test|^foo|^bar|^default$|^password\d?$|^secret\d?$|^token\d?$|xxx|\*\*\*|\.\.\.|…|123456$|abcdef|deadbeef|0000000",
    re.I,
)
_TEMPLATED = re.compile(r"\$\{|\{\{|\{[A-Za-z_][\w.\[\]()'\"]*(?:![rsa])?\}|%\(?\w*\)?[sd]\b|%s|\$\(|<%|\$[A-Z_]{3,}|%[A-Z_]+%|@@|#\{")
_WHOLLY = re.compile(r"\W*(?:\$?\{[^{}]*\}|\$?\{\{[^{}]*\}\}|<%?[^<>]*%?>|%\(?\w*\)?[sd])\W*")
_ENV = re.compile(r"environ|getenv|process\.env|import\.meta\.env|\benv\b|vault|secrets?manager|get_secret|getSecret|keyring|config\.get|settings\.|load_dotenv|ssm", re.I)
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
_SRI = re.compile(r"sha(?:1|224|256|384|512)[-:]|md5[-:]|data:|urn:|https?:")
_REGEXY = re.compile(r"\[[^\]]*-[^\]]*\]|\{\d+,?\d*\}|\\[dwsb]|\(\?")
_USERINFO = re.compile(r"[a-zA-Z][\w+.\-]*://[^\s/:@\"'`]*:([^\s\"'`]+?)@(?=[\w.\-\[$({])")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_BODY = re.compile(r"(?:\\+[nr]|[\s\"'+,\\#*/]|Proc-Type:[^\n]*|DEK-Info:[^\n]*)*([A-Za-z0-9+/=]{16,})")
_TOKEN = re.compile(r"(?<=\s-)p(?=\w{4})|[A-Za-z0-9_]+|[^\sA-Za-z0-9_]|[^\x00-\x7f]+")
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\\n]|\\.)*`")
_COMMENT = re.compile(r"(?:^|(?<=[\s;{})]))(?:#|//|/\*|\*(?=\s)|--(?=\s))")
_SHELL = re.compile(r"\s*(?:export\s+)?[A-Z][A-Z0-9_]*=(?=[^\s=\"'`(\[{]+\s*$)")
_ATOM = re.compile(r"[^\s\"'`]+")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_\-]*")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_SYMBOL = re.compile(r"[^A-Za-z0-9_]")
#: A hash is no name, whatever words its letters make.
_HASH = re.compile(r"(?=[0-9a-f]*\d)[0-9a-f]{8,}")


def name_parts(name: str) -> list[str]:
    return [p.lower() for p in _PART.findall(name)]


def _bucket(n: int) -> int:
    return n if n < 6 else 6 if n < 8 else 8 if n < 12 else 12 if n < 16 else 16 if n < 24 else 24 if n < 36 else 36 if n < 48 else 48 if n < 80 else 80 if n < 120 else 120 if n < 220 else 220


@lru_cache(maxsize=10_000)
def _basic(atom: str) -> bool:
    """Whether the text is base64 of ``user:password``."""
    if not 8 <= len(atom) <= 400 or not re.fullmatch(r"[A-Za-z0-9+/]+={0,2}", atom):
        return False
    try:
        raw = base64.b64decode(atom + "=" * (-len(atom) % 4))
    except (binascii.Error, ValueError):
        return False
    return raw.isascii() and raw.decode("ascii").isprintable() and 0 < raw.find(b":") < len(raw) - 3


def _atom_features(atom: str) -> tuple[tuple[str, ...], bool]:
    """Of an atom; only short ones are kept in memory."""
    return _short_atom_features(atom) if len(atom) <= 200 else _short_atom_features.__wrapped__(atom)


@lru_cache(maxsize=50_000)
def _short_atom_features(atom: str) -> tuple[tuple[str, ...], bool]:
    """Features of a run without spaces in a literal, and whether a secret may begin in it."""
    lower, upper = bool(re.search("[a-z]", atom)), bool(re.search("[A-Z]", atom))
    digit, symbol = bool(re.search(r"\d", atom)), bool(_SYMBOL.search(atom))
    n = len(atom)
    kinds = "l" * lower + "u" * upper + "d" * digit + "s" * symbol
    found = [f"ak:{kinds}", f"al:{_bucket(n)}", f"akl:{kinds}:{_bucket(n)}"]
    distinct = len(set(atom.lower()))
    spread = distinct / min(n, 24)
    found.append(f"sp:{int(spread * 5)}")
    m = _PREFIX.match(atom)
    if m:
        rest = atom[m.end() :]
        good = len(rest) >= 10 and len(set(rest)) > 5 and not _REGEXY.search(rest)
        found.append("pre+" if good else "pre-")
    if re.fullmatch(r"[0-9a-fA-F]+", atom):
        found.append(f"hex:{n if n in (32, 40, 56, 64, 96, 128) else _bucket(n)}")
        found.append("hex")
    if _UUID.search(atom):
        found.append("uuid")
    if _SRI.match(atom):
        found.append("sri")
    if _PLACEHOLDER.search(atom):
        found.append("ph")
    if distinct <= 3:
        found.append("mask")
    if _TEMPLATED.search(atom):
        found.append("tpl")
    if _REGEXY.search(atom):
        found.append("rx")
    if _basic(atom):
        found.append("b64pair")
    if re.fullmatch(r"[A-Za-z_]+(?:[-_.:/][A-Za-z_]+)*", atom):
        found.append("words")
    if re.fullmatch(r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+|[A-Z_]+", atom):
        found.append("const")
    if re.fullmatch(r"[\w.\-]+\.[a-z]{2,}(?:[:/][\w.\-/:?=&%]*)?", atom) or "/" in atom and not digit:
        found.append("path")
    if re.fullmatch(r"[a-zA-Z]+[_\-]?\d{1,3}|\d+|v?\d+(?:\.\d+)+\w*", atom):
        found.append("idnum")
    if "pre+" in found:
        found = [f for f in found if f not in ("const", "words", "idnum", "path")]
    flips = len(re.findall(r"[A-Za-z]\d|\d[A-Za-z]|[a-z][A-Z]", atom))
    found.append(f"fl:{min(flips, 6)}")
    candidate = n >= 6 and (digit and (lower or upper) or symbol and (lower or upper) and n >= 8 or lower and upper or bool(m))
    return tuple(found), candidate and not _WHOLLY.fullmatch(atom)


class Line:
    """Tokens of a line with their features; ``open`` tells where a secret may begin."""

    __slots__ = ("spans", "features", "open")

    def __init__(self, spans, features, open_):
        self.spans, self.features, self.open = spans, features, open_


def lex(line: str, before: str = "", in_string: bool = False, skip_closed: bool = False) -> Line:
    """``before``: the line above; ``in_string``: the line begins within a string of several lines."""
    literals: list[tuple[int, int, str]] = []
    shell = _SHELL.match(line)
    if in_string:
        literals.append((0, len(line), "str"))
    elif shell:
        literals.append((shell.end(), len(line), "str"))
    else:
        at = 0
        comment = None
        for m in _STRING.finditer(line):
            c = _COMMENT.search(line, at, m.start())
            if c:
                comment = c.start()
                break
            literals.append((m.start() + 1, m.end() - 1, "str"))
            at = m.end()
        if comment is None:
            c = _COMMENT.search(line, at)
            if c:
                comment = c.start()
            else:
                tail = line.find('"""', at)
                tail = tail if tail >= 0 else line.find("'''", at)
                tail = tail if tail >= 0 else line.find("`", at)
                if tail >= 0:
                    literals.append((tail, len(line), "str"))
        if comment is not None:
            literals.append((comment, len(line), "com"))
    joined = ""
    if len(literals) > 1 and re.search(r"[\"'`]\s*\+?\s*[\"'`]", line):
        for (a, b, k), (c, _, k2) in zip(literals, literals[1:]):
            if k == k2 == "str" and re.fullmatch(r"[\"'`]\s*\+?\s*[\"'`]", line[b:c]):
                joined = line[a:b] + line[c : literals[literals.index((a, b, k)) + 1][1]]
                break
    atoms: list[tuple[int, int, str, tuple[str, ...], bool]] = []
    for a, b, kind in literals:
        for m in _ATOM.finditer(line, a, b):
            text = m.group()
            end = m.end()
            stripped = text.rstrip(",;.)]}") if kind == "com" or in_string else text
            if len(stripped) < len(text):
                end -= len(text) - len(stripped)
                text = stripped
            if text:
                f, c = _atom_features(text)
                atoms.append((m.start(), end, kind, f, c))
    if joined:
        f, c = _atom_features(joined)
        if "pre+" in f:
            atoms = [(s, e, k, (*f, "joined"), True) if k == "str" and e - s >= 2 and line[s:e] in joined else (s, e, k, g, d) for s, e, k, g, d in atoms]
    users = [m.span(1) for m in _USERINFO.finditer(line)] if "://" in line else []
    if skip_closed and not users and not any(atom[4] for atom in atoms):
        return Line([], [], [])
    env = bool(_ENV.search(line))
    spans, features, open_ = [], [], []
    words: list[str] = name_parts(" ".join(_NAME.findall(before)[-1:])) if re.search(r"[=(:,\[{]\s*$", before) and re.match(r"\s*[\"'`]", line) else []
    recent: list[str] = [f"up:{w}" for w in words]
    j = 0
    tokens = list(_TOKEN.finditer(line))
    key: list[str] = list(words)
    last_name: list[str] = list(words)
    for i, m in enumerate(tokens):
        s, e, text = m.start(), m.end(), m.group()
        while j < len(atoms) and atoms[j][1] <= s:
            j += 1
        inside = j < len(atoms) and atoms[j][0] <= s
        prev = tokens[i - 1].group() if i else "^"
        nxt = tokens[i + 1].group() if i + 1 < len(tokens) else "$"
        glued = i > 0 and tokens[i - 1].end() == s
        if text in ("=", ":", ">") or text in (",", "(") and last_name:
            if last_name:
                key = last_name
        is_word = text[0].isalnum() or text[0] == "_"
        kinds = ("l" * any(ch.islower() for ch in text) + "u" * any(ch.isupper() for ch in text) + "d" * any(ch.isdigit() for ch in text)) if is_word else "p"
        f = ["b", f"k:{kinds}", f"n:{_bucket(len(text))}", f"p:{prev if not prev[0].isalnum() else 'W'}:{int(glued)}", f"q:{nxt if not nxt[0].isalnum() else 'W'}"]
        if not is_word:
            f.append(f"t:{text}")
        if inside:
            start, end, ctx, shape, candidate = atoms[j]
            f.append(f"c:{ctx}")
            first = s == start
            f.append("first" if first else "later")
            f += shape
            f += [f"{'F' if first else 'L'}{x}" for x in shape[:1]]
            user = any(a <= s < b for a, b in users)
            if user:
                f.append("user0" if any(a == s for a, _ in users) else "user+")
                f.append("userlast" if any(b == e for _, b in users) else "userin")
                secret = next(line[a:b] for a, b in users if a <= s < b)
                if _TEMPLATED.search(secret) or _PLACEHOLDER.search(secret):
                    f.append("userph")
            elif users and start <= users[0][0] < end:
                f.append("urlrest")
            own = f"own:{_own_kind(text)}"
            f += [own, own + (":first" if first else ":later")]
            strong = bool(STRONG.intersection(key))
            cred = strong or bool(CRED.intersection(key))
            against = bool(AGAINST.intersection(key))
            state = f"key:{'S' if strong else 'C' if cred else '-'}{'A' if against else ''}"
            f += [state, f"{state}:{own}", f"{state}:{shape[0]}"]
            f += [f"kw:{w}" for w in key[-3:]]
            if prev in ("=", ":") and glued:
                f.append(f"after:{prev}:{state}")
            for flag in ("ph", "mask", "tpl", "rx", "const", "words", "uuid", "sri", "pre+", "b64pair", "hex", "idnum", "path"):
                if flag in shape:
                    f.append(f"{flag}|{state}")
                    f.append(f"{flag}|{'first' if first else 'later'}")
            if env:
                f.append("env")
                f.append(f"env|{'const' in shape}")
            if prev == "p" or re.match(r"-p\w", line[start:end]):
                f.append("dash-p")
            f += recent[-2:]
            open_.append(candidate or user)
        else:
            f.append("c:code")
            open_.append(False)
        spans.append((s, e))
        features.append(f)
        if is_word and not text.isdigit() and not _HASH.fullmatch(text):
            parts = name_parts(text)
            if len(text) <= 32 and len(parts) <= 6:
                last_name = parts
                if "bearer" in parts or "basic" in parts:
                    recent.append(f"rec:{parts[-1]}")
                    key = parts
                elif STRONG.intersection(parts):
                    recent.append("rec:strong")
    return Line(spans, features, open_)


@lru_cache(maxsize=50_000)
def _own_kind(text: str) -> str:
    """Coarse look of one token."""
    if not (text[0].isalnum() or text[0] == "_"):
        return "p"
    if text.isdigit():
        return "num"
    if re.fullmatch(r"[a-z]+|[A-Z][a-z]+|[A-Z]+|[a-z]+(?:_[a-z]+)+|[a-z]+(?:[A-Z][a-z]+)+|[A-Z]+(?:_[A-Z]+)+", text):
        return "word" if len(text) < 16 else "longword"
    if len(text) < 6:
        return "bit"
    return "mix" if len(text) < 14 else "longmix"


class Crf:
    """Weights of a chain over O, B and I."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray, start: np.ndarray):
        self.index, self.weights, self.moves, self.start = index, weights, moves, start
        self.cache: dict[tuple[str, str, bool], tuple[tuple[int, int], ...]] = {}
        self._rows = [tuple(row) for row in weights.tolist()]
        self._moves = moves.tolist()
        self._start = start.tolist()

    def __reduce__(self):
        return Crf, (self.index, self.weights, self.moves, self.start)

    def of(self, line: str, before: str, in_string: bool) -> tuple[tuple[int, int], ...]:
        """Places of the secrets in a text line; repeated lines are labelled once."""
        if len(line) + len(before) > 500:
            return tuple(self.spans(lex(line, before, in_string, True)))
        key = (line, before, in_string)
        found = self.cache.get(key)
        if found is None:
            if len(self.cache) >= 100_000:
                self.cache.clear()
            found = self.cache[key] = tuple(self.spans(lex(line, before, in_string, True)))
        return found

    def spans(self, line: Line) -> list[tuple[int, int]]:
        """Viterbi: places of the secrets in the line."""
        if not any(line.open):
            return []
        index, rows, moves = self.index, self._rows, self._moves
        back: list[tuple[int, int, int]] = []
        o = b = i = 0.0
        for t, names in enumerate(line.features):
            so = sb = si = 0.0
            for name in names:
                k = index.get(name)
                if k is not None:
                    x, y, z = rows[k]
                    so += x
                    sb += y
                    si += z
            if not line.open[t]:
                sb = -1e9
            if t == 0:
                o, b, i = self._start[0] + so, self._start[1] + sb, -1e9
                continue
            fo = (o + moves[0][0], b + moves[1][0], i + moves[2][0])
            fb = (o + moves[0][1], b + moves[1][1], i + moves[2][1])
            fi = (-1e9, b + moves[1][2], i + moves[2][2])
            po, pb, pi = fo.index(max(fo)), fb.index(max(fb)), fi.index(max(fi))
            back.append((po, pb, pi))
            o, b, i = fo[po] + so, fb[pb] + sb, fi[pi] + si
        last = max(range(3), key=lambda k: (o, b, i)[k])
        path = [last]
        for step in reversed(back):
            path.append(step[path[-1]])
        path.reverse()
        found: list[tuple[int, int]] = []
        for (s, e), label in zip(line.spans, path):
            if label == 1:
                found.append((s, e))
            elif label == 2 and found:
                found[-1] = (found[-1][0], e)
        return found


def train(lines: list[Line], labels: list[list[int]], *, epochs: int = 40, rate: float = 0.3, decay: float = 1e-4, least: int = 2) -> Crf:
    """Maximum conditional likelihood with AdaGrad over all lines at once; forward-backward runs on padded arrays."""
    counts: dict[str, int] = {}
    for line in lines:
        for names in line.features:
            for name in names:
                counts[name] = counts.get(name, 0) + 1
    index = {name: k for k, name in enumerate(sorted(n for n, c in counts.items() if c >= least))}
    longest = max(len(x.spans) for x in lines)
    n = len(lines)
    token, feature = [], []
    y = np.zeros((n, longest), np.int64)
    on = np.zeros((n, longest), bool)
    closed = np.zeros((n, longest), bool)
    for r, (line, label) in enumerate(zip(lines, labels)):
        y[r, : len(label)] = label
        on[r, : len(label)] = True
        closed[r, : len(label)] = [not x for x in line.open]
        for t, names in enumerate(line.features):
            for name in names:
                k = index.get(name)
                if k is not None:
                    token.append(r * longest + t)
                    feature.append(k)
    token, feature = np.array(token), np.array(feature)
    size = len(index)
    w, moves, start = np.zeros((size, 3)), np.zeros((3, 3)), np.zeros(3)
    gw, gm, gs = np.full((size, 3), 1e-6), np.full((3, 3), 1e-6), np.full(3, 1e-6)
    gold = np.eye(3)[y] * on[..., None]
    first_gold = gold[:, 0].sum(0)
    pair_gold = np.einsum("rta,rtb->ab", gold[:, :-1] * on[:, 1:, None], gold[:, 1:])
    banned = np.zeros((3, 3))
    banned[0, 2] = -1e4
    for _ in range(epochs):
        scores = np.stack([np.bincount(token, w[feature, k], n * longest) for k in range(3)], -1).reshape(n, longest, 3)
        scores[..., 1] -= 1e4 * closed
        step = moves + banned
        alpha = np.zeros((n, longest, 3))
        beta = np.zeros((n, longest, 3))
        alpha[:, 0] = start + scores[:, 0] + np.array([0, 0, -1e4])
        for t in range(1, longest):
            new = _lse(alpha[:, t - 1, :, None] + step, 1) + scores[:, t]
            alpha[:, t] = np.where(on[:, t, None], new, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = _lse(step + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(on[:, t + 1, None], new, 0)
        total = _lse(alpha[:, -1], 1)
        marginal = np.exp(np.clip(alpha + beta - total[:, None, None], -60, 0)) * on[..., None]
        pair = np.exp(np.clip(alpha[:, :-1, :, None] + step + (scores[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None], -60, 0))
        pair_sum = (pair * on[:, 1:, None, None]).sum((0, 1))
        rest = (gold - marginal).reshape(-1, 3)
        grad = np.stack([np.bincount(feature, rest[token, k], size) for k in range(3)], -1) / n - decay * w
        for x, g, acc in ((w, grad, gw), (moves, (pair_gold - pair_sum) / n - decay * moves, gm), (start, (first_gold - marginal[:, 0].sum(0)) / n, gs)):
            acc += g * g
            x += rate * g / np.sqrt(acc)
    return Crf(index, w, moves + banned, start)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))


def private_keys(text: str) -> list[tuple[int, int]]:
    """Places of private keys in armour that have a body; one without is a mention."""
    found = []
    for m in _PEM.finditer(text):
        body = _PEM_BODY.match(text, m.end())
        if body is None or len(set(body.group(1))) < 8:
            continue
        end = text.find("-----END", body.end())
        close = text.find("-----", end + 8) if end >= 0 else -1
        found.append((m.start(), close + 5 if close >= 0 else len(text)))
    return found

"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Fixed base rules find e-mail and IP addresses, card and phone numbers. Looser
patterns propose further spans: other spellings, further kinds such as secrets, and near
misses of the base rules, which are what the models learn to refuse. Regex, checksum (for
secrets: entropy), gazetteer and context labelers vote on every candidate;
expectation-maximisation over the counts of vote patterns estimates per kind how reliable
each labeler is, and its posteriors train a logistic classifier over votes and features of
the span that no labeler sees. Votes and features are discrete, so both models learn
from a table of pattern counts whose size does not depend on the corpus. Base spans
always stay.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.blocks import stored

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "name", "secret")
LABELERS = ("shape", "checksum", "gazetteer", "context", "anticontext", "border")
ACCEPT = 0.8
CONTEXT_CHARS = 40
#: Weight of the assumption that labelers tend to be right, as a share of a kind's candidates.
PRIOR_SHARE = 0.05
#: Candidates at which a kind's own vote tables weigh as much as those of all kinds together.
POOL = 20.0
#: Votes of the strong labeler of a kind, wrong and right spans: one number in ten passes a checksum by chance.
#: They weigh as much as all candidates, as context alone would else form the classes.
STRONG_VOTES = ((0.89, 0.01, 0.1), (0.01, 0.01, 0.98))
#: Penalty on squared weights of the classifier.
RIDGE = 0.1

# fixed values: common given names, titles, top-level domains, country codes and context words
GIVEN_NAMES = frozenset(
    "Anna Maria Marie Sophie Laura Julia Sarah Emma Olivia Emily Jessica Jennifer Linda Susan Karen Lisa Nancy Elena Carmen Lucia Isabel "
    "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Peter Hans Klaus Jürgen "
    "Wolfgang Stefan Andreas Jean Pierre Michel Philippe Nicolas José Juan Carlos Luis Miguel Antonio Manuel Pedro".split()
)
TITLES = frozenset("Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Señor Señora Don Doña".split())
DOMAINS = frozenset("com org net edu gov info io co de fr es it uk us eu ch at nl be ca au jp cn in br mx ru pl se no dk fi example".split())
CALLING_CODES = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "7", "81", "86", "91")
IBAN_COUNTRIES = frozenset("AT BE CH CZ DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split())
CONTEXT = {
    "email": "mail contact write kontakt schreiben écrire correo",
    "ip": "ip address host server login adresse dirección",
    "card": "card visa mastercard credit payment karte carte tarjeta",
    "phone": "phone tel call mobile fax telefon handy téléphone teléfono móvil",
    "iban": "iban bank account konto compte cuenta transfer",
    "ssn": "ssn social security",
    "name": "name named contact dear author signed regards liebe cher querido",
    "secret": "secret credential login access authoriz private passwor passwd geheim clave contraseña",
}
ANTICONTEXT = "version isbn issn order invoice total page chapter release build serial part number issue"
SECRET_ANTICONTEXT = "sha commit revision checksum md5 digest hash etag uuid fingerprint"
SECRET_NAMES = "token secret password passwd passwort pwd apikey api_key api-key access_key access-key auth_key bearer credential"
SECRET_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "sk_live_", "sk-", "xoxb-", "xoxp-", "AIza", "eyJ")
DIGEST_SIZES = (32, 40, 48, 56, 64, 96, 128)

_ALNUM = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
_LOCAL = _ALNUM + "._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LETTER = re.compile(r"[A-Za-z]")

_AT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]{1,63}){1,8}")
_NATIONAL = re.compile(r"(?<![0-9A-Za-z+.-])\(?0[0-9]{1,5}\)?[ /-][0-9]{2,8}(?:[ -][0-9]{2,8}){0,4}(?![0-9A-Za-z])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NAME = re.compile(r"(?<![A-Za-zß-ÿ])[A-Z][a-zß-ÿ]{1,20} [A-Z][a-zß-ÿ]{1,20}(?![A-Za-zß-ÿ])")
# possessive runs: no text makes them go back
_LONG = re.compile(r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_-]{20,}+=*")
_KEYED = re.compile(rf"(?i)(?<![a-z])(?:{'|'.join(SECRET_NAMES.split())})[\"']?[ \t]{{0,3}}(?:=>|[=:])?[ \t]{{0,3}}[\"']?([A-Za-z0-9+/_.~!$-]{{8,}}+=*)")
_KEY_BEFORE = re.compile(rf"(?i)(?<![a-z])(?:{'|'.join(SECRET_NAMES.split())})[\"']?[ \t]{{0,3}}(?:=>|[=:])[ \t]{{0,3}}[\"']?$")
_HEX = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
_DIGITS = re.compile(r"(?<![0-9A-Za-z+.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])")
_FOUR = re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,4}(?:\.[0-9]{1,4}){3}(?![0-9A-Za-z]|\.[0-9])")
_PLUS = re.compile(r"(?<![0-9A-Za-z+])\+[0-9](?:[ ().-]{0,2}[0-9]){5,19}(?![0-9A-Za-z])")
_WORDS = {kind: re.compile(rf"(?i)(?<!\w)(?:{'|'.join(words.split())})") for kind, words in CONTEXT.items()}
_ANTI = re.compile(rf"(?i)(?<!\w)(?:{'|'.join(ANTICONTEXT.split())})(?!\w)")
_ANTI_SECRET = re.compile(rf"(?i)(?<!\w)(?:{'|'.join(SECRET_ANTICONTEXT.split())})")
_TITLE = re.compile(rf"(?:{'|'.join(sorted(TITLES))})\.? $")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost address around each @; the local part is the run of its characters not yet used.

    Equal to a regex scan, but linear: a scan would start again inside every long run.
    """
    done, at = 0, text.find("@")
    while at >= 0:
        start, step = at, 64
        while start > done:
            low = max(done, start - step)
            left = len(text[low:start].rstrip(_LOCAL))
            start, step = low + left, 2 * step
            if left:
                break
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Every four parts in a row of a dotted chain of numbers, if none is above 255."""
    for chain in _DOTTED.finditer(text):
        at = chain.start()
        parts = chain[0].split(".")
        for i in range(0, len(parts) - 3, 4):
            size = sum(map(len, parts[i : i + 4])) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[i : i + 4]):
                yield at, at + size
            at += size + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of all base matches in order; linear in the text."""
    found = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        found += [(a, 1, b) for a, b in _addresses(text)]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _proposals(text: str) -> Iterator[tuple[int, int, int]]:
    if "(at)" in text or "[at]" in text:
        yield from ((m.start(), 0, m.end()) for m in _AT.finditer(text))
    if _DIGIT.search(text):
        yield from ((m.start(), 3, m.end()) for m in _NATIONAL.finditer(text))
        yield from ((m.start(), 4, m.end()) for m in _IBAN.finditer(text))
        yield from ((m.start(), 5, m.end()) for m in _SSN.finditer(text))
        yield from ((m.start(), 1, m.end()) for m in _FOUR.finditer(text))
        yield from ((m.start(), 2, m.end()) for m in _DIGITS.finditer(text))
        yield from ((m.start(), 3, m.end()) for m in _PLUS.finditer(text))
        yield from ((m.start(), 7, m.end()) for m in _LONG.finditer(text) if _DIGIT.search(m[0]) and _LETTER.search(m[0]))
    yield from ((m.start(1), 7, m.end(1)) for m in _KEYED.finditer(text))
    for m in _NAME.finditer(text):
        first = m[0].partition(" ")[0]
        if first in GIVEN_NAMES or first in TITLES or _TITLE.search(text, max(0, m.start() - 12), m.start()):
            yield m.start(), 6, m.end()


def entropy(span: str) -> float:
    """Bits per character of the characters of a span."""
    counts = np.unique(np.frombuffer(span.encode("utf-32-le"), "<u4"), return_counts=True)[1] / len(span)
    return float(-(counts * np.log2(counts)).sum())


def _secret_votes(text: str, start: int, end: int) -> tuple[str, str, str]:
    """Votes on a secret: its form, its entropy, and a name that it is assigned to."""
    span = text[start:end].rstrip("=")
    pieces = [p for p in re.split("[^A-Za-z0-9]+", span) if p]
    form = "0"
    if span.startswith(SECRET_PREFIXES) or (len(span) in DIGEST_SIZES and _HEX.fullmatch(span)):
        form = "+"
    elif all(p.isalpha() or p.isdigit() for p in pieces):
        form = "-"  # words and numbers, as in paths and names
    bits = entropy(span) if span else 0.0
    keyed = _KEY_BEFORE.search(text, max(0, start - CONTEXT_CHARS), start)
    return form, "+" if bits >= 3.0 else "-" if bits < 2.5 else "0", "+" if keyed else "-"


def _votes(text: str, start: int, kind: int, end: int, base: bool) -> str:
    """One character per labeler: ``+`` for, ``-`` against, ``0`` no opinion."""
    span = text[start:end]
    digits = re.sub("[^0-9]", "", span)
    before, name = text[max(0, start - CONTEXT_CHARS) : start], KINDS[kind]
    form, checksum, gazetteer = "+" if base else "0", "0", "0"
    if name == "email":
        gazetteer = "+" if re.split(r"[^A-Za-z0-9-]+", span.rstrip(")]"))[-1].lower() in DOMAINS else "-"
    elif name == "ip":
        wrong = any(len(p.lstrip("0")) > 3 or int(p) > 255 for p in span.split("."))
        checksum = "-" if wrong or span.startswith(("0.", "127.", "255.")) else "+"
    elif name == "card":
        checksum = "+" if 14 <= len(digits) <= 19 and luhn(digits) else "-"
        gazetteer = "+" if digits[0] in "3456" else "-"
    elif name == "phone":
        checksum = "+" if 9 <= len(digits) <= 15 else "-"
        gazetteer = ("+" if digits.startswith(CALLING_CODES) else "-") if span[0] == "+" else "0"
    elif name == "iban":
        flat = span.replace(" ", "")
        checksum = "+" if int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1 else "-"
        gazetteer = "+" if flat[:2] in IBAN_COUNTRIES else "-"
    elif name == "ssn":
        checksum = "-" if span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" or span[7:] == "0000" else "+"
    elif name == "secret":
        form, checksum, gazetteer = _secret_votes(text, start, end)
    else:
        words = span.split()
        gazetteer = "+" if words[0] in GIVEN_NAMES else "0"
        checksum = "+" if words[0] in TITLES or _TITLE.search(text, max(0, start - 12), start) else "0"
    context = "+" if _WORDS[name].search(before) else "0"
    anti = "-" if (_ANTI_SECRET if name == "secret" else _ANTI).search(before) else "0"
    around = text[start - 1 : start] + text[end : end + 1]
    border = "-" if any(c.isalnum() or c in "/_" for c in around) or (name != "secret" and "=" in around) else "+"
    return form + checksum + gazetteer + context + anti + border


def _shape(span: str) -> str:
    """Features that no labeler sees: coarse length, digit share, letter case and separators."""
    share = sum(c in "0123456789" for c in span) / len(span)
    case = 2 * any(c.isupper() for c in span) + any(c.islower() for c in span)
    marks = {c for c in span if not c.isalnum()}
    separators = 0 if not marks else 1 if marks == {" "} else 2 if marks <= set("-_") else 3 if marks == {"."} else 4
    return f"{min(len(span) // 8, 5)}{int(share * 3)}{case}{separators}"


_FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans array<struct<start:long,kind:int,stop:long,base:boolean,pattern:string>>"
_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64()), ("base", pa.bool_()), ("pattern", pa.string())])


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            counts, texts, spans = np.zeros((part.num_rows, 4), np.int64), [], []
            for i, value in enumerate(part.column("text")):
                text = value.as_py() or ""
                base = base_spans(text)
                for _, kind, _ in base:
                    counts[i, kind] += 1
                texts.append(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base))
                spans.append([_candidate(text, a, k, b, True) for a, k, b in base] + _extra(text, base))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(counts[:, k]) for k in range(4)), pa.array(texts, pa.string()), pa.array(spans, pa.list_(_SPAN))],
                names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base", "spans"],
            )


def _candidate(text: str, start: int, kind: int, stop: int, base: bool) -> dict:
    pattern = f"{kind}{_votes(text, start, kind, stop, base)}{_shape(text[start:stop])}"
    return {"start": start, "kind": kind, "stop": stop, "base": base, "pattern": pattern}


def _extra(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Proposals that overlap no base span, nor an earlier proposal of the same kind."""
    out: list[dict] = []
    last: dict[int, int] = {}
    starts = [a for a, _, _ in base]
    reach = np.maximum.accumulate([b for _, _, b in base]) if base else np.zeros(0, np.int64)
    for a, kind, b in sorted(_proposals(text)):
        at = bisect_left(starts, b)  # base spans that begin before the proposal ends
        if (at and reach[at - 1] > a) or last.get(kind, 0) > a:
            continue
        last[kind] = b
        out.append(_candidate(text, a, kind, b, False))
    return out


def _strong(kind: int) -> int:
    """The labeler whose rates are known beforehand: the checksum, for secrets the name they are assigned to."""
    return LABELERS.index("gazetteer" if KINDS[kind] == "secret" else "checksum")


def label_model(patterns: list[str], counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns: posterior of each pattern, and P(vote | class) per labeler over all kinds.

    Every kind has its own prior and, for each labeler, its own table of votes given the
    class: a checksum means something else for cards than a title does for names. Tables of
    kinds with few candidates lean on the tables of all kinds. A small share of each table
    says that labelers tend to be right, which keeps the classes in order. The start
    is the majority of votes, where the strong labeler counts three times; its rates are mostly
    given (``STRONG_VOTES``), those of the others are learned from how they agree with it.
    """
    votes = np.array([["-0+".index(c) for c in p[1 : 1 + len(LABELERS)]] for p in patterns])
    kind = np.array([int(p[0]) for p in patterns])
    strong = np.array([_strong(k) for k in kind])
    weigh = np.where(np.arange(len(LABELERS)) == strong[:, None], 3.0, 1.0)
    post = 1 / (1 + np.exp(-((votes - 1) * weigh).sum(axis=1)))
    is_vote = (votes[:, :, None] == np.arange(3)).astype(float)  # pattern, labeler, vote
    is_kind = (kind[:, None] == np.arange(len(KINDS))).astype(float)
    size = counts @ is_kind
    known = np.zeros((len(KINDS), 2, len(LABELERS), 3))
    for k in range(len(KINDS)):
        known[k, :, _strong(k)] = STRONG_VOTES
    honest = np.array([[0.6, 0.3, 0.1], [0.1, 0.3, 0.6]])[:, None]  # class, any labeler, vote
    for _ in range(rounds):
        weight = np.stack([counts * (1 - post), counts * post])
        pooled = np.einsum("cp,plv->clv", weight, is_vote) + 1.0 + PRIOR_SHARE * size.sum() * honest
        pooled /= pooled.sum(axis=2, keepdims=True)
        own = np.einsum("cp,pk,plv->kclv", weight, is_kind, is_vote)
        table = own + POOL * pooled + size[:, None, None, None] * (PRIOR_SHARE * honest + known)
        table /= table.sum(axis=3, keepdims=True)
        prior = (weight @ is_kind + 1.0).T
        prior /= prior.sum(axis=1, keepdims=True)
        score = np.log(prior[kind]) + np.einsum("plv,pclv->pc", is_vote, np.log(table[kind]))
        post = 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -50, 50)))
    return post, pooled


def _features(patterns: list[str]) -> np.ndarray:
    """Kind, votes of the kind and shape as indicator columns, shapes also by kind."""
    n_votes, shapes = 3 * len(LABELERS), (6, 4, 4, 5)
    each = n_votes + sum(shapes)
    out = np.zeros((len(patterns), 1 + each * (len(KINDS) + 1)))
    out[:, 0] = 1
    for row, p in enumerate(patterns):
        votes = ["-0+".index(c) + 3 * j for j, c in enumerate(p[1 : 1 + len(LABELERS)])]
        starts = np.cumsum([n_votes, *shapes])
        values = votes + [int(v) + int(a) for v, a in zip(p[1 + len(LABELERS) :], starts)]
        for at in (1, 1 + each * (1 + int(p[0]))):  # columns of all kinds, and of this one
            out[row, at + np.array(values)] = 1
    return out


def span_classifier(patterns: list[str], counts: np.ndarray, target: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Probability of each pattern under a logistic model fitted to soft labels by Newton steps."""
    x = _features(patterns)
    weights = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (counts * (target - p)) - RIDGE * weights
        curve = (x * (counts * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + RIDGE * np.eye(x.shape[1])
        weights += np.linalg.solve(curve, slope)
    return 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))


def find_personal_data(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """Spans per row of ``docs(doc_id, text)``.

    Returns doc_id, n_email, n_ip, n_card, n_phone and base (the base spans as
    ``kind:start:end`` by start, then kind), and spans: those and every further
    candidate that the classifier accepts, as structs. Offsets count code points, the
    end is exclusive. A null or empty text has none; repeated rows are searched each, an
    empty table gives no rows. Other columns of ``docs`` do not matter. Long texts are
    searched whole, in time linear in their length. Of candidates of one kind that overlap
    the leftmost counts, the shorter one on ties, and none that overlaps a base span.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = stored(rows.mapInArrow(_found, _FOUND), "pii")
    seen = found.select(F.explode("spans").alias("s")).groupBy("s.pattern").agg(F.count(F.lit(1)).alias("n"))
    learned = sorted((r["pattern"], r["n"]) for r in seen.collect())  # at most kinds x votes x shapes
    good: list[str] = []
    if learned:
        patterns, counts = [p for p, _ in learned], np.array([n for _, n in learned], float)
        chance = span_classifier(patterns, counts, label_model(patterns, counts)[0])
        good = [p for p, c in zip(patterns, chance) if c >= accept]
    accepted = F.array(*map(F.lit, good)) if good else F.array().cast("array<string>")
    kept = F.filter("spans", lambda s: s["base"] | F.array_contains(accepted, s["pattern"]))
    return found.withColumn("spans", F.array_sort(kept))


def spans_text(spans: Column) -> Column:
    """Spans as ``kind:start:end`` joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")

"""Credentials in source code and configuration: find and mask them.

Candidates (values in quotes, in assignments, in markup, command flags and headers, in URLs, connection strings, logins and PEM
blocks) are cut out of every text. A character Markov chain, its pair counts summed over the bytes of the whole corpus, says how unlike
the corpus a value is. A logistic regression weighs that likelihood, the words of the identifiers around the value, its form and the
path of its file. It is trained on weak labels: patterns that are surely credentials or surely none label a
sample of at most SAMPLE candidates chosen by hash; two thirds fit the weights, the rest calibrates them (Platt scaling).
Every labelled candidate is learnt twice, once with the pattern features masked that labelled it, so that likelihood, names, form and path have to
tell it too; calibration sees both. Candidates with a calibrated probability of at least CUT are credentials;
masking replaces their letters and digits by asterisks, all else (quotes, line ends, PEM frames, lengths) staying as it is.

Defined cases: a null, empty or credential-free text gives no row and is returned unchanged by masking; several
credentials that begin in one line are one row; texts of the same hash count once; without labelled
candidates of both kinds the weak labels alone decide; other columns are dropped.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import clean_key, cut

SAMPLE = 40_000
CUT = 0.5
MASKED = 0.25  # weight of a candidate's masked copy in training

QUOTED = re.compile(r"""(["'`])((?:\\.|(?!\1)[^\\\n])*)\1""")
JOIN = re.compile(r"""\s*\+?\s*\\?[ \t]*\r?\n\s*\+?\s*(["'`])((?:\\.|(?!\1)[^\\\n])*)\1""")
CONTINUES = re.compile(r"[ \t]*(?:\+[ \t]*\\?|\\)[ \t]*\r?$|[ \t]*\r?\n[ \t]*\+", re.M)
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----((?:(?!-----BEGIN)[\s\S])*?)-----END \1-----")
BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----")
# what can follow the header of an unclosed frame: lines of base64 and of PEM headers, quoted and joined or not
PEM_LINES = re.compile(r"(?:[ \t\"'`+,;]|\\[nr]?|\r?\n|(?:Proc-Type|DEK-Info):[^\n\"'`\\]*|(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{16,}={0,2}(?![\w.\-])|(?<![A-Za-z0-9+/=])(?=[A-Za-z0-9+/]*[0-9+/])[A-Za-z0-9+/]{4,15}={0,2}(?=[ \t]*(?:[\"'`]|\\[nr]|\r?\n|$)))*+")
URL = re.compile(r"(?<![A-Za-z0-9+.\-])([a-z][a-z0-9+.\-]{1,20}://)([^\s:/@\"'`]*+):([^\s@\"'`/]+)@")
URL_USER = re.compile(r"(?<![A-Za-z0-9+.\-])([a-z][a-z0-9+.\-]{1,20}://)([^\s:/@\"'`?#]{8,})@")
URL_QUERY = re.compile(r"(?<=[?&])([A-Za-z_][\w.\-]*)=([^\s&#\"'`<>]{5,})")
WEBHOOK = re.compile(r"https?://[^\s\"'`/?#]+/(?:[^\s\"'`/?#]+/)*?(?:(?:api/)?webhooks?|services|hooks)/([^\s\"'`?#]*?[A-Za-z0-9_\-]{16,})(?=[\s\"'`?#,;)]|$)")
HEADER = re.compile(r"(?i)\b((?:Proxy-)?Authorization|X-[\w\-]*(?:Key|Token|Secret)|Private-Token|Api-Key)[ \t]*:[ \t]*((?:(?:Bearer|Basic|Token)[ \t]+)?[^\s\"'`,;<>{}()$]{5,})(?=[\"'`])")
CONNECTION = re.compile(r"(?i)\b(AccountKey|SharedAccessKey|Password|Pwd|Secret)=([^;\s\"'`]{4,})")
BARE = re.compile(r"(?m)^[ \t]*(?:-[ \t]+)?(?:(?:export|set|ENV)[ \t]+)?([A-Za-z_][\w.\-]*)[ \t]*[:=][ \t]*((?:Bearer |Basic )?[^\s\"'`#(){}\[\],<>$][^\s\"'`(){}\[\],]{4,}?)[ \t]*;?(?:[ \t]+(?:#|//)[^\n]*)?[ \t]*\r?$")
NOTE = re.compile(r"(?m)\b([A-Za-z_][\w.\-]*)[ \t]+(?:#|//)[ \t]*(?:[A-Za-z]+:?[ \t]+)*((?:Bearer |Basic )?[^\s\"'`]{5,})[ \t]*\r?$")
NETRC = re.compile(r"\blogin[ \t]+(\S+)[ \t]+password[ \t]+(\S+)")
LOGIN = re.compile(r"(?m)(?:^|[ \t])(?://|#|--|/\*|\*)[^\n]*:[ \t]*[\w.\-@]+[ \t]+/[ \t]+(\S+)[ \t]*\r?$")
CURL = re.compile(r"(?:\s-u|--user)[ \t=]+([^\s:\"']+):((?:Bearer |Basic )?[^\s\"']+)")
MARKUP = re.compile(r"<([A-Za-z_][\w.\-]*)>([^<>\n]{3,})</\1>")
FLAG = re.compile(r"(?<![\w\-])--?((?:[A-Za-z]+-)*(?:password|passwd|pass|passphrase|token|secret|api-key|access-key))(?:=|[ \t]+)([^\s\"'`$<>\-][^\s\"'`]{3,})")
SHORT_FLAG = re.compile(r"\b(?:mysql|mysqldump|mysqladmin|mariadb|mongo|sshpass)\b[^\n|;&]*?[ \t]-p[ \t]?([^\s\"'`$<>\-|;&][^\s\"'`|;&]{3,})")
PAIR = re.compile(r"\([ \t]*([\"'`])([\w.@\-]{2,})\1[ \t]*,[ \t]*([\"'`])([^\s\"'`]{6,})\3[ \t]*\)")
KEY = re.compile(r"""([A-Za-z_][\w.\-]*)["'`\]]*\s*(?::\s*&?[\w<>']+\s*=|:=|=>|[=:,(])\s*&?[bBrRuUfF]{0,2}$""")

# Words of names that hold secrets, that hold public digests or numbers, and stand-ins.
STRONG = re.compile(r"passw|passwd|\bpass\b|\bpwd\b|passphrase|passcode|secret|credential|api ?key|access ?key|private ?key|signing ?key|encryption ?key|cert ?key|authorization|\bbearer\b|(?:auth|access|registry|refresh|deploy|bot|api|session) ?token")
PASS = re.compile(r"(?:password|passwd|\bpwd|\bpass|passphrase|passcode)\d*$")
USERS = re.compile(r"(?i)^(?:admin\w*|root|sa|user\w*|guest|deploy\w*|ci[\w\-]*|bot|svc[\w\-]*|service[\w\-]*|postgres|mysql|oracle|operator|test\w*|[\w.\-]+@[\w.\-]+)$")
# what a name says about a secret without being one, and words of notes to people
ABOUT = re.compile(r"\b(?:hint|field|label|name|names|input|type|kind|url|uri|link|path|file|dir|policy|placeholder|prompt|message|msg|error|rule|rules|regex|pattern|title|text|help|description|column|header|param|selector|class|manager|provider|service|store|env|var|format|strength|status|state|form|view|page|ref)$")
PROSE = re.compile(r"(?i)\b(?:your|enter|please|must|should|required|invalid|incorrect|forgot|forgotten|reset|change|confirm|missing|characters?|the|is|are|of|for|password|passwords|secret|token|key|string|hidden|value|field)\b")
WEAK = re.compile(r"\btoken\b|\bkey\b|\bauth\b|\bsession\b|\bconn\b|\bheader\b|\bpem\b|\bdsn\b|\bcookie\b")
DIGEST = re.compile(r"hash|commit|etag|integrity|\bsha\d*\b|digest|checksum|\bid\b|uuid|guid|\bicon\b|fixture|trace|\bdocs?\b|revision|version|fingerprint|public")
COUNTED = re.compile(r"\b(?:len|length|size|bytes|bits|min|max|age|ttl|days|hours|minutes|seconds|timeout|expir\w*|count|limit|retries|attempts|rounds|iterations|port|version|id|at|time|index|offset|num\w*)\b")
STAND_IN = re.compile(
    r"(?i)^(?:x{4,}|\*+|\.{3,}|dummy\w*|example.*|sample.*|placeholder.*|change[-_]?me.*|replace[-_ ]?me.*|redacted.*|todo.*|fixme.*|your[-_ ].*|my[-_ ](?:secret|password|token|key).*|test|none|null|undefined|true|false|secret|password|token|<[^>]*>|\$\{[^}]*\}|\$\w+|\{\{.*\}\}|\{env:.*\}|%\w+%|\$\(.*\)|env\..*|vault:.*|.*\bexample-(?:password|secret|token|key)\b.*)$"
)
UUID = re.compile(r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{8,12}$")
HEX = re.compile(r"^(?:0x)?[0-9a-fA-F]{12,}$")
JWT = re.compile(r"^(?:Bearer )?eyJ[\w\-]+\.[\w\-]+\.[\w\-]*$")
BASIC = re.compile(r"^Basic [A-Za-z0-9+/]{6,}={0,2}$")
ISSUED = re.compile(r"^(?:[A-Za-z]{2,6}(?:[_\-.~][A-Za-z0-9]{1,5}){0,2}[_\-.~](?=[A-Za-z0-9]*[0-9])(?=[A-Za-z0-9]*[A-Za-z])[A-Za-z0-9]{14,}|(?=[A-Z]*[0-9])[A-Z][A-Z0-9]{15,39})$")
# Published forms of issued keys.
KNOWN = re.compile(r"^(?:Bearer )?(?:AIza[\w\-]{30,}|xox[abeoprs]-[\w\-]{8,}|gh[opusr]_\w{20,}|github_pat_\w{20,}|glpat-[\w\-]{16,}|sk_live_\w{12,}|rk_live_\w{12,}|sk-[\w\-]{20,}|AKIA[A-Z0-9]{12,}|ASIA[A-Z0-9]{12,}|npm_\w{20,}|pypi-[\w\-]{20,}|SG\.[\w\-]{10,}\.[\w\-]{10,}|ya29\.[\w\-]{10,}|hf_\w{20,}|dop_v1_\w{20,}|shpat_\w{20,})$")
OPEN_DATA = re.compile(r"^(?:data:|sha\d+-|https?://[^@]*$|[\w./\\]+\.(?:log|json|yaml|yml|ts|js|py|rs|go|java|md|toml|sh|txt|png)$)")
PHRASE = re.compile(r"^[A-Za-z]+(?:[-_.][A-Za-z]+)+[-_.]\d+$|^[A-Z][a-z]+\d{2,}\W*$")
NAME = re.compile(r"^[A-Za-z_][\w.]*$")
HUMPS = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|[_\-.\s]+")

FEATURES = ["bias", "strong_name", "weak_name", "digest_name", "named_value", "stand_in", "bits", "excess", "length", "hex", "uuid", "token_form", "basic", "issued", "open_data", "phrase", "words", "mixed", "pem_private", "pem_public", "url", "login", "connection", "counted", "letters", "known", "passphrase", "about", "classes", "spaces"]
#: The words of the name a value has, hashed to so many features.
WORDS = 24
#: Features that labels are made of; masked in the second copy of every candidate that training sees.
PATTERNS = ["named_value", "stand_in", "uuid", "token_form", "basic", "issued", "open_data", "words", "pem_private", "pem_public", "url", "login", "connection", "counted", "letters", "known", "passphrase", "about", "digest_name"]


def pair_counts(texts: DataFrame, text: str) -> np.ndarray:
    """How often each character (128 codes, the last for all others) follows each, over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 14, np.int64)
        for batch in batches:
            for t in batch.column(0):
                codes = np.minimum(np.frombuffer((t.as_py() or "").encode("utf-8", "replace"), np.uint8), 127).astype(np.int64)
                if len(codes) > 1:
                    total += np.bincount((codes[:-1] << 7) | codes[1:], minlength=1 << 14)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["pair", "n"])

    counts = texts.select(text).mapInArrow(run, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    out = np.zeros(1 << 14)
    for r in counts.collect():  # at most 2^14 rows
        out[r["pair"]] = r["n"]
    return out.reshape(128, 128)


def chain_bits(counts: np.ndarray) -> list[list[float]]:
    """Bits of each transition; unseen ones share a small weight."""
    smooth = counts + 0.5
    return (-np.log2(smooth / smooth.sum(1, keepdims=True))).tolist()


def words_of(name: str) -> str:
    return " ".join(w.lower() for w in HUMPS.split(name) if w)


def describe(kind: str, key: str, value: str, bits: list[list[float]]) -> list[float]:
    """The features of a candidate, in the order of FEATURES, then the hashed words of its name."""
    name = words_of(key)
    strong = bool(STRONG.search(name))
    about = bool(ABOUT.search(name))
    digest = bool(DIGEST.search(name)) and not strong
    bare_value = re.sub(r"^(?:Bearer|Basic) ", "", value)
    stand_in = not value or bool(STAND_IN.match(value)) or bool(STAND_IN.match(bare_value))
    codes = [c if c < 127 else 127 for c in value.encode("utf-8", "replace")]
    per = sum(bits[a][b] for a, b in zip(codes, codes[1:], strict=False)) / max(1, len(codes) - 1)
    digit, upper, lower = (any(f(c) for c in value) for f in (str.isdigit, str.isupper, str.islower))
    classes = digit + upper + lower + any(not c.isalnum() for c in value)
    # one word of letters under a name of secrets: how unlike the corpus it is decides, not the label
    letters = strong and not about and kind in ("quoted", "bare") and value.isalpha() and len(value) >= 6 and not stand_in
    plain = not digit and not ((upper and lower or letters) and per > 6.5) and "!" not in value
    identifier = kind == "bare" and bool(NAME.match(value)) and not digit and plain
    # words that are a password all the same, told by the name alone
    passphrase = kind in ("quoted", "markup", "flag") and bool(PASS.search(name)) and plain and len(value) >= 5 and not stand_in and not PROSE.search(value) and bool(re.fullmatch(r"[A-Za-z]+(?:[ \-_]?[A-Za-z]+)*", value))
    pem = kind == "pem"
    private = pem and "PRIVATE" in key
    opened = float(bool(OPEN_DATA.match(value)))
    counted = value.isdigit() and bool(COUNTED.search(name))
    named = strong and not about and not stand_in and not counted and not plain and not identifier and not opened and len(value) >= 5
    known = bool(KNOWN.match(value)) and not stand_in
    if about and strong and not known and kind in ("quoted", "bare", "markup"):
        stand_in = stand_in or " " in value or plain or bool(PHRASE.match(value)) or "#" in value or bool(re.fullmatch(r"[a-z0-9]+(?:[.\-][a-z0-9]+)+", value))
    features = [
        1.0,
        float(strong),
        float(bool(WEAK.search(name))),
        float(digest),
        float(named),
        float(stand_in or identifier),
        min(per, 16.0) / 8,
        min(max(0.0, per - 5.0) * len(codes), 300.0) / 100,
        min(len(value), 100) / 50,
        float(bool(HEX.match(value))),
        float(bool(UUID.match(value))),
        float(bool(JWT.match(value))),
        float(bool(BASIC.match(value))),
        float(bool(ISSUED.match(value)) and not stand_in and not digest),
        opened,
        float(bool(PHRASE.match(value))),
        float(plain and not letters and not passphrase),
        float(classes >= 3),
        float(private),
        float(pem and not private),
        float(kind == "url" and not stand_in),
        float(kind in ("netrc", "login", "curl", "pair") and not stand_in and not opened and not UUID.match(value)),
        float(kind == "connection" and not stand_in),
        float(counted),
        float(letters and not passphrase),
        float(known),
        float(passphrase),
        float(about),
        classes / 4,
        float(" " in bare_value),
    ]
    words = [0.0] * WORDS
    for w in name.split():
        words[zlib.crc32(w.encode()) % WORDS] = 1.0
    return features + words


AT = {name: i for i, name in enumerate(FEATURES)}


def weak_label(f: list[float]) -> int:
    """1 surely a credential, 0 surely none, -1 unsaid."""
    g = lambda n: f[AT[n]] > 0
    if g("pem_private"):
        return 1
    if g("known"):
        return 1
    if g("pem_public") or g("stand_in") or g("uuid") or g("open_data") or g("digest_name") or g("counted"):
        return 0
    if g("url") or g("login") or g("connection") or g("token_form") or g("basic") or g("issued") or g("named_value") or g("passphrase"):
        return 1
    if g("letters"):  # not so unlike as to be surely one
        return -1
    if g("words") or not (g("strong_name") or g("weak_name")):
        return 0
    return -1


def candidates(text: str) -> list[tuple[str, str, str, list[tuple[int, int]]]]:
    """(kind, key, value, spans of the value) of all places that could hold a credential."""
    out: list[tuple[str, str, str, list[tuple[int, int]]]] = []
    frames: list[tuple[int, int]] = []
    if "-----BEGIN" in text:
        for m in PEM.finditer(text):
            frames.append(m.span())
            out.append(("pem", m[1], m[2], [m.span(2)]))
        for m in BEGIN.finditer(text):
            if not any(a <= m.start() < b for a, b in frames):
                # without an end it goes as far as its base64
                end = m.end() + len(PEM_LINES.match(text, m.end())[0].rstrip(" \t\r\n\"'`+,;\\"))
                frames.append((m.start(), end))
                if end > m.end():
                    out.append(("pem", m[1], text[m.end() : end], [(m.end(), end)]))
    inside = lambda i: any(a <= i < b for a, b in frames)
    for m in URL.finditer(text):
        out.append(("url", m[1], m[3], [m.span(3)]))
    known = {span for *_, places in out for span in places}

    def part(kind: str, key: str, at: tuple[int, int]) -> None:
        if at not in known and not inside(at[0]):
            known.add(at)
            out.append((kind, key, text[at[0] : at[1]], [at]))

    if "://" in text:
        for m in URL_USER.finditer(text):
            part("part", "token" if ISSUED.match(m[2]) or JWT.match(m[2]) else "user", m.span(2))
        for m in WEBHOOK.finditer(text):
            part("part", "webhook secret", m.span(1))
    if "=" in text:
        for m in URL_QUERY.finditer(text):
            if STRONG.search(words_of(m[1])) or WEAK.search(words_of(m[1])) or re.search(r"(?i)^(?:sig|signature)$", m[1]):
                part("part", "access token" if WEAK.search(words_of(m[1])) and re.search(r"token|auth", m[1], re.I) else "secret" if m[1].lower().startswith("sig") else m[1], m.span(2))
    for m in HEADER.finditer(text):
        part("part", "authorization", m.span(2))
    for m in CONNECTION.finditer(text):
        out.append(("connection", m[1], m[2], [m.span(2)]))
    for kind, pattern, group, word in (("netrc", NETRC, 2, "login"), ("curl", CURL, 2, "-u"), ("login", LOGIN, 1, " / ")):
        if word in text or (kind == "curl" and "--user" in text):
            for m in pattern.finditer(text):
                value = m[group]
                if not inside(m.start()) and "://" not in value and ";AccountName=" not in value:
                    out.append((kind, kind, value, [m.span(group)]))
    for kind, pattern, mark in (("markup", MARKUP, "</"), ("flag", FLAG, "-")):
        if mark in text:
            for m in pattern.finditer(text):
                if STRONG.search(words_of(m[1])) or WEAK.search(words_of(m[1])):
                    part(kind, m[1], m.span(2))
    if "-p" in text:
        for m in SHORT_FLAG.finditer(text):
            part("flag", "password", m.span(1))
    for m in PAIR.finditer(text):
        if USERS.match(m[2]) and sum((any(map(str.isdigit, m[4])), any(map(str.isupper, m[4])), any(map(str.islower, m[4])), any(not c.isalnum() for c in m[4]))) >= 3 and "://" not in m[4]:
            part("pair", m[2], m.span(4))
    taken = -1
    ends = [0, 0]  # where the last two literals ended: no name stands before the one before the last
    for m in QUOTED.finditer(text):
        if m.start() < taken:
            continue
        value, spans = m[2], [m.span(2)]
        if m.span(2) in known:
            continue
        taken = m.end()
        while (tail := CONTINUES.match(text, taken)) and (more := JOIN.match(text, taken)):
            value += more[2]
            spans.append(more.span(2))
            taken = more.end()
        if "://" in value or "-----BEGIN" in value or ";AccountName=" in value or (frames and inside(m.start())):
            continue
        start = max(text.rfind("\n", ends[0], m.start()) + 1, ends[0])
        ends = [ends[1], taken]
        named = KEY.search(text, start, m.start())
        key = named[1] if named else ""
        if len(value) < 5 and not STRONG.search(words_of(key)):
            continue
        if value.isdigit() and not STRONG.search(words_of(key)):
            continue
        if not any(c.isdigit() or c.isupper() for c in value) and not STRONG.search(words_of(key)):
            continue
        if " " in value and not value.startswith(("Bearer ", "Basic ")) and not STRONG.search(words_of(key)):
            continue
        out.append(("quoted", key, value, spans))
    for m in (*BARE.finditer(text), *NOTE.finditer(text)):
        value = m[2]
        strong = STRONG.search(words_of(m[1]))
        if "://" in value or (value.isdigit() and not strong) or ";AccountName=" in value or value in ("false;", "true;"):
            continue
        if not strong and not any(c.isdigit() for c in value):
            continue
        if m.re is NOTE and not strong and not ISSUED.match(value) and not JWT.match(value) and not BASIC.match(value):
            continue
        if frames and inside(m.start()):
            continue
        out.append(("bare", m[1], value.rstrip(";"), [(m.start(2), m.start(2) + len(value.rstrip(";")))]))
    return out


def extract(texts: DataFrame, key: str, text: str, bits: list[list[float]]) -> DataFrame:
    """One row per candidate: key, line_no, spans (flat start, end), features, weak label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lines, spans, features, labels = [], [], [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = t.as_py()
                if not t:
                    continue
                for kind, name, value, places in candidates(t):
                    f = describe(kind, name, value, bits)
                    keys.append(k)
                    first = places[0][0]
                    if kind == "pem":
                        first = t.rfind("-----BEGIN", 0, first)
                    lines.append(t.count("\n", 0, first) + 1)
                    spans.append([x for p in places for x in p])
                    features.append(f)
                    labels.append(weak_label(f))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(lines, pa.int32()), pa.array(spans, pa.list_(pa.int32())), pa.array(features, pa.list_(pa.float32())), pa.array(labels, pa.int32())],
                ["k", "line_no", "spans", "features", "label"],
            )

    kept = texts.where(F.col(key).isNotNull() & (F.length(text) > 0)).select(F.col(key).alias("k"), text)
    return kept.mapInArrow(run, "k string, line_no int, spans array<int>, features array<float>, label int").withColumnRenamed("k", key)


def path_features(path: Column) -> Column:
    low = F.lower(F.coalesce(path, F.lit("")))
    flag = lambda pattern: F.when(low.rlike(pattern), 1.0).otherwise(0.0).cast("float")
    return F.array(flag(r"\.(json|ya?ml|toml|env|ini|cfg|properties|sh|bash)$"), flag(r"(^|/)(tests?|spec|fixtures?|examples?|docs?)/"), flag(r"^$"))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.02, rounds: int = 40, weight: np.ndarray | None = None) -> np.ndarray:
    """Newton steps of a ridge logistic regression; weight of each row, 1 by default."""
    weight = np.ones(len(y)) if weight is None else weight
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(sample: list) -> tuple[np.ndarray, float, float]:
    """Weights and Platt scale and offset."""
    labelled = [r for r in sample if r["label"] >= 0]
    y = np.array([r["label"] for r in labelled], float)
    size = len(FEATURES) + WORDS + 3
    x = np.array([list(r["features"]) + list(r["path_features"]) for r in labelled], float).reshape(len(y), size)
    if len(y) < 20 or y.min() == y.max():
        w = np.zeros(size)
        for n in ("named_value", "token_form", "basic", "issued", "pem_private", "url", "login", "connection", "known", "passphrase"):
            w[AT[n]] = 8.0
        for n in ("stand_in", "uuid", "open_data", "pem_public"):
            w[AT[n]] = -16.0
        w[0] = -4.0
        return w, 1.0, 0.0
    held = np.arange(len(y)) % 3 == 0
    hidden = x.copy()
    hidden[:, [AT[n] for n in PATTERNS]] = 0.0
    twice = lambda rows: (np.concatenate([x[rows], hidden[rows]]), np.concatenate([y[rows], y[rows]]), np.repeat([1.0, MASKED], rows.sum()))
    seen, truth, weight = twice(~held)
    w = fit_logistic(seen, truth, weight=weight)
    seen, truth, weight = twice(held)
    platt = fit_logistic(np.stack([seen @ w, np.ones(len(seen))], 1), truth, penalty=0.1, weight=weight)
    return w, float(max(platt[0], 1e-3)), float(platt[1])


def scored(rows: DataFrame, paths: DataFrame, key: str, text: str) -> DataFrame:
    """Candidates of all texts with their calibrated probability. paths: (key, file_path)."""
    bits = chain_bits(pair_counts(rows, text))
    found = extract(rows, key, text, bits)
    where = paths.where(f"{key} IS NOT NULL").groupBy(key).agg(F.min("file_path").alias("file_path"))
    found = cut(found.join(where, key, "left").withColumn("path_features", path_features(F.col("file_path"))))
    order = F.xxhash64(key, "line_no", "spans")
    n = found.where("label >= 0").count()
    share = int(min(1.0, SAMPLE / max(1, n)) * (1 << 20))
    sample = found.where("label >= 0").where(F.pmod(order, F.lit(1 << 20)) < share).orderBy(order).limit(SAMPLE).select("features", "path_features", "label").collect()
    w, scale, offset = train(sample)
    weights = F.array(*[F.lit(float(v)) for v in w])
    z = F.aggregate(F.zip_with(F.concat("features", "path_features"), weights, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)
    return found.withColumn("probability", 1 / (1 + F.exp(-(z * scale + offset))))


def once(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Every text once, whatever rows carry it."""
    return cut(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(text).alias(text)))


def credential_lines(rows: DataFrame, paths: DataFrame, key: str, text: str) -> DataFrame:
    return scored(once(rows, key, text), paths, key, text).where(F.col("probability") >= CUT).select(key, "line_no").distinct()


def masked(text: str, spans: list[int]) -> str:
    """Letters, digits and marks inside the spans as asterisks; white space, escapes and quotes stay."""
    out, at = [], 0
    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
        a = max(a, at)
        if b > a:
            out += [text[at:a], re.sub(r"(?<!\\)[^\s\\\"'`]", "*", text[a:b])]
            at = b
    return "".join([*out, text[at:]])


def redact(rows: DataFrame, paths: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, n_masked): every text once, with its credentials masked."""
    texts = once(rows, key, text)
    hits = scored(texts, paths, key, text).where(F.col("probability") >= CUT)
    spans = hits.groupBy(key).agg(F.flatten(F.collect_list("spans")).alias("spans"), F.count("*").alias("n_masked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [masked(t, s) if s and t else t for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(done, pa.string()), batch.column("n")], ["k", "text", "n_masked"])

    sent = texts.join(spans, key, "left").select(F.col(key).alias("k"), F.col(text).alias("text"), "spans", F.coalesce("n_masked", F.lit(0)).alias("n"))
    return sent.mapInArrow(run, "k string, text string, n_masked bigint").withColumnRenamed("k", key)


def hashed(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(clean_key("content_hash").alias("content_hash"), *columns)

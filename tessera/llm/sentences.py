"""Sentence units across languages and scripts.

A text falls into blocks: headings, list items and fenced code are units of their own, code layouts give a unit a
line, and what lies between blank lines is a paragraph. Whether single line ends wrap a paragraph or end units is read off
the whole document: wrapped paragraphs end in a terminator, lists of unit lines have lost theirs.

Inside a paragraph every terminator is a node of a lattice. It has the reading that a sentence ends there and others
(abbreviation, initial, ordinal, ellipsis, inside a quotation or bracket), each with a cost from its context, and a sentence
from one end to the next has a cost of its own (a bare number or a fragment of a word is no sentence). The cheapest path holds.

In scripts without spaces or terminators the phrases between spaces are cut into words by the cheapest path through
a dictionary lattice. A gap ends a sentence after a final particle, before an opening word, before a clause after a clause, or where
the script changes. The dictionary is a short list of function words (a parameter) and what the corpus itself shows (``lexicon``):
phrases that recur are words, and those that begin paragraphs about as often as phrases are opening words.

Defined cases: null, empty and blank texts have no units; offsets count code points from 0, the
end exclusive; units have no surrounding white space; an unclosed fence runs to the end; an unclosed quotation or bracket counts as a
plain character; a repeated row gives its units once; a null layout is plain; other columns are dropped.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut

# Abbreviations that never end a sentence, and those that may.
NEVER = set("Dr Prof Mr Mrs Ms Messrs Sr Sra Srta Dra Mme Mlle MM Hr Fr Nr Nrn Abb Abschn Kap Bd Vgl vgl ca Ca bzw inkl zzgl ggf evtl Tab Sec sec Sect Fig fig Figs figs Eq Ch Vol vol pp approx Approx aprox Aprox vs cf Cf viz env ex ej núm Núm pág См см рис Рис табл Табл ок Ок г гг стр напр им ул κ Κ κα περ Περ σελ Δρ Καθ د م أ ص डॉ श्री प्रो e.g E.g i.e I.e z.B d.h u.a p.ex p.ej т.е т.н π.χ Π.χ δηλ मि.से कि.मी से.मी रु".split())
TITLES = set("Gen Lt Col Sgt Cpl Capt Cmdr Adm Maj Brig Hon Rev Gov Sen Rep Pres Supt Dept Univ Assn Bros Ave Blvd Rd Mt Ft incl Incl excl Mio Mrd Tsd Std Tel Art Abs Anm Bsp geb gest Ing Dipl Sta Ud Uds Vd Vds Mgr Mtro Lic тыс млн млрд руб проф акад".split())
MAYBE = set("etc usw a.m p.m A.M P.M U.S U.K E.U U.N д п κ.λπ κ.ά κτλ др пр Inc Ltd Co Corp Jr St al Ph.D vb bspw".split())
NUMBERED = set("no No nos Nos Nr p P S n N".split())
#: months that are written with a capital after an ordinal; elsewhere they are in lower case and open nothing
MONTHS = set("Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember".split())
# Function words of the scripts without spaces: final particles, opening words (pronouns, kin, connectives, question
# words), words that carry a clause on, and common verbs. More of them come from a parameter and from the corpus.
FINALS = set("ครับ ค่ะ คะ นะคะ นะครับ นะ จ้ะ จ้า สิ เถอะ ละ ล่ะ ฮะ หรอก เลย แหละ ເດີ ແດ່ ນໍ ເນາະ ບໍ ດອກ".split())
OPENERS = set("กรุณา ทำไม ตั้งแต่ เมื่อ เมื่อวาน วันนี้ พรุ่งนี้ ถ้า หาก แต่ เพราะ ดังนั้น เรา ผม ฉัน ดิฉัน เขา เธอ มัน คุณ ท่าน พวกเขา พวกเรา แม่ พ่อ พี่ น้อง ลูก ครู เพื่อน โปรด นี่ นั่น นอกจากนี้ อย่างไรก็ตาม จากนั้น ต่อมา ใคร อะไร ที่ไหน เมื่อไร ຂ້ອຍ ເຮົາ ລາວ ພວກເຮົາ ເຈົ້າ ມັນ ກະລຸນາ ຖ້າ ເມື່ອ ແຕ່ ເພາະ ມື້ນີ້ ແມ່ ພໍ່ ខ្ញុំ យើង គាត់ នាង ពួកគេ សូម ប្រសិនបើ ប៉ុន្តែ ហេតុអ្វី ថ្ងៃនេះ ကျွန်တော် ကျွန်မ သူ သူမ သူတို့ ဒါပေမယ့် ယနေ့".split())
CARRIES = set("และ หรือ ที่ ซึ่ง อัน ว่า เพื่อ โดย ของ ใน จาก ถึง กับ แก่ ต่อ ก็ จึง แล้ว จะ ได้ ให้ เป็น คือ ไม่ ด้วย รวมทั้ง เช่น แห่ง ระหว่าง ແລະ ຫຼື ທີ່ ຂອງ ໃນ ວ່າ ເພື່ອ ກັບ និង ឬ ដែល របស់ ក្នុង ដើម្បី ថា".split())
VERBS = set("เป็น คือ มี ไป มา อยู่ ทำ ใช้ กิน ดื่ม ซื้อ ขาย เห็น ดู ฟัง พูด บอก ถาม ตอบ รู้ คิด ชอบ รัก อยาก ต้อง เรียน สอน อ่าน เขียน เล่น นอน ตื่น เดิน วิ่ง นั่ง ยืน เปิด ปิด ให้ เอา รับ ส่ง ช่วย หา พบ เจอ เริ่ม หยุด เรียก คืน สร้าง เก็บ ลบ เพิ่ม ลด แก้ ว่าง ดี ร้อน หนาว สวย ใหญ่ เล็ก มาก ໄປ ມາ ຢູ່ ມີ ເປັນ ເຮັດ ກິນ ຊື້ ຂາຍ ເຫັນ ຮູ້ ຮັກ ດີ ទៅ មក មាន ជា ធ្វើ ទិញ ញ៉ាំ នៅ ល្អ".split())
CONTINUES = set("と って という とか なんて".split())
SPEAKERS = re.compile(r"(?:他们|她们|我们|他|她|它|我|你|您|有人|作者|记者)?(?:又|也|就|便|回|反)?(?:问|说|道|写|答|喊|叫|想|表示|认为)")
HARD = "。！？｡．।॥။។៕።։"
SOFT = ".!?؟۔…‽"
CLOSERS = "\"'”’»›」』）)]］】〉》“"
OPENS = {"“": "”", "„": "“”", "«": "»", "»": "«", "‹": "›", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）", "【": "】", "《": "》", '"': '"', "`": "`"}
FRAME = re.compile("[" + re.escape("".join(OPENS)) + "]")
SIGN = re.compile("[" + re.escape("".join(OPENS) + HARD + SOFT) + ";]")
GREEK = re.compile("[Ͱ-Ͽἀ-῿]+")
BRACKETS = re.compile(r"[()\[\]（）【】]")
HEADING = re.compile(r"[ ]{0,3}#{1,6}(?:\s|$)")
ITEM = re.compile(r"\s*(?:[-*+•]|\d{1,3}[.)])\s+\S")
BULLET = re.compile(r"\s*[-*+•]\s+\S")
FENCE = re.compile(r"\s*(```+|~~~+)")
LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|$)")
SPACELESS = re.compile(r"[฀-๿຀-໿ក-៿က-႟]")
THAI = SPACELESS
RUN = re.compile(r"[฀-๿຀-໿ក-៿က-႟]+")
#: Phrases that make up at least this share of all phrases of spaceless scripts are words of the dictionary: at most 1 / SHARE of them.
SHARE = 2e-5
#: A word opens sentences if its share among paragraph starts is at least this part of its share among phrases.
OPENING = 0.2
FEWEST = 5
ENDED = re.compile(r"[.!。！।]$")
OPENISH = re.compile(r"[\w)\]`]$")


@dataclass
class Lexicon:
    """Words of the spaceless scripts with their costs; final particles, opening words and verbs among them."""

    finals: set[str] = field(default_factory=lambda: set(FINALS))
    openers: set[str] = field(default_factory=lambda: set(OPENERS))
    verbs: set[str] = field(default_factory=lambda: set(VERBS))
    carries: set[str] = field(default_factory=lambda: set(CARRIES))
    costs: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for w in (*self.finals, *self.openers, *self.verbs, *self.carries, *CONTINUES):
            self.costs.setdefault(w, 1.0)
        self.longest = max(map(len, self.costs))


PLAIN = Lexicon()


def lines_of(text: str) -> list[tuple[int, int]]:
    """Start and end of each line, without its line end."""
    out, at = [], 0
    while at < len(text):
        m = LINE.match(text, at)
        out.append((at, at + len(m[0].rstrip("\r\n"))))
        at = m.end()
    return out


def stripped(text: str, start: int, end: int) -> tuple[int, int] | None:
    while start < end and text[start].isspace():
        start += 1
    while end > start and text[end - 1].isspace():
        end -= 1
    return (start, end) if start < end else None


def units(text: str | None, layout: str | None, words: Lexicon = PLAIN) -> list[tuple[int, int]]:
    """The sentence units of one document."""
    if not text:
        return []
    out: list[tuple[int, int]] = []
    lines = lines_of(text)

    def add(start: int, end: int) -> None:
        span = stripped(text, start, end)
        if span:
            out.append(span)

    if layout == "code":
        for a, b in lines:
            add(a, b)
        return out
    item = ITEM if layout == "markdown" else BULLET
    blocks: list[list[tuple[int, int]]] = []  # paragraphs, in order with placeholders for other units
    kinds: list[str] = []
    i, fresh = 0, True
    while i < len(lines):
        a, b = lines[i]
        line = text[a:b]
        if not line.strip():
            fresh = True
            i += 1
            continue
        fence = FENCE.match(line)
        if fence:
            j = i + 1
            while j < len(lines) and not re.match(rf"\s*{re.escape(fence[1])}\s*$", text[slice(*lines[j])]):
                j += 1
            last = min(j, len(lines) - 1)
            blocks.append([(a, lines[last][1])])
            kinds.append("unit")
            i, fresh = last + 1, True
            continue
        if HEADING.match(line):
            blocks.append([(a, b)])
            kinds.append("unit")
            fresh = True
        elif item.match(line):
            blocks.append([(a, b)])
            kinds.append("item")
            fresh = False
        elif not fresh and kinds:
            blocks[-1].append((a, b))
        else:
            blocks.append([(a, b)])
            kinds.append("text")
            fresh = False
        i += 1
    wraps = wrapped(text, [x for x, k in zip(blocks, kinds, strict=True) if k == "text"], words)
    for block, kind in zip(blocks, kinds, strict=True):
        if kind != "text":
            add(block[0][0], block[-1][1])
        elif wraps:
            out += sentences(text, block[0][0], block[-1][1], words)
        else:
            for a, b in block:
                out += sentences(text, a, b, words)
    return out


def wrapped(text: str, paragraphs: list[list[tuple[int, int]]], words: Lexicon = PLAIN) -> bool:
    """Whether single line ends wrap: paragraphs then end in terminators, and no line had room for the
    next word."""
    if all(len(p) < 2 for p in paragraphs):
        return True
    ended = unended = 0
    for p in paragraphs:
        tail = text[slice(*p[-1])].rstrip()
        ended += bool(ENDED.search(tail))
        unended += bool(OPENISH.search(tail)) and not re.search(r"[.!?。！？।]['\"”’»」』)\]]*$", tail)
    if ended != unended:
        return ended > unended
    if any(len(sentences(text, *line, words)) > 1 for p in paragraphs if len(p) > 1 for line in p):
        return True  # unit lines hold one sentence each
    room = tight = 0
    for p in paragraphs:
        for (a, b), (c, d) in zip(p, p[1:], strict=False):
            word = text[c:d].split()[0]
            full = len(text[a:b].rstrip()) + 1 + len(word) > 70
            if full and (coded(word) or not opens(text, c, d) or text[a:b].rstrip()[-1] in ",;:"):
                tight += 1
            else:
                room += 1
    return tight > room


def coded(token: str) -> bool:
    """Whether a token is a name or path of a program, which may open a sentence in lower case."""
    core = token.rstrip(".,;:!?)]\"'»”").lstrip("([\"'«“„¿¡")
    return bool(re.search(r"[_/\\(){}`=\d@#]|[a-z][A-Z]|\w\.\w|::", core)) or token.startswith("`")


def opens(text: str, at: int, end: int) -> bool:
    """Whether what follows (after white space) may begin a sentence."""
    while at < end and text[at].isspace():
        at += 1
    if at >= end:
        return True
    stop = at
    while stop < end and not text[stop].isspace():
        stop += 1
    token = text[at:stop]
    if token.startswith("`"):
        return True
    core = token.lstrip("\"'“„«»‹「『([（【¿¡*_‘")
    if not core:
        return token[0] not in "—–-»"
    if core[0] in "—–-,;:)]":
        return False
    if core[0].islower() and unicodedata.category(core[0]) == "Ll":
        return coded(core)
    return True


def frames(text: str, start: int, end: int) -> list[tuple[int, int, bool]]:
    """Top-level quotations, brackets and code spans: (opening, closing, is a quotation)."""
    closing: dict[int, int] = {}
    stacks: dict[str, list[int]] = {c: [] for c in "([（【"}
    partner = {OPENS[c]: c for c in stacks}
    for m in BRACKETS.finditer(text, start, end):
        c = m[0]
        if c in stacks:
            stacks[c].append(m.start())
        elif stacks[partner[c]]:
            closing[stacks[partner[c]].pop()] = m.start()
    out, at = [], start
    without: set[str] = set()  # openings that no closing follows any more
    for m in FRAME.finditer(text, start, end):
        i, c = m.start(), m[0]
        if i < at or c in without or (c == "»" and i > start and text[i - 1].isalnum()):
            continue
        if c in stacks:
            close = closing.get(i, -1)
        else:
            found = [j for j in (text.find(x, i + 1, end) for x in OPENS[c]) if j >= 0]
            close = min(found) if found else -1
            if close < 0:
                without.add(c)
        if close > 0:
            out.append((i, close, c not in "([（【`"))
            at = close + 1
    return out


def word_after(text: str, at: int, end: int) -> str:
    """The next run without white space."""
    while at < end and text[at].isspace():
        at += 1
    stop = at
    while stop < end and not text[stop].isspace():
        stop += 1
    return text[at:stop]


def readings(text: str, start: int, at: int, last: int, end: int) -> dict[str, float]:
    """Costs of the readings of the terminators text[at:last] of a paragraph from start to end."""
    run = text[at:last]
    costs = {"end": 1.0}
    if not opens(text, last, end):
        costs["inside"] = 0.5
    dots = run.strip("!?؟")
    if "…" in dots or "..." in dots:
        spaced = at > start and text[at - 1].isspace()
        following = word_after(text, last, end)
        if spaced or not (following[:1].isupper() or not following):
            costs["ellipsis"] = 0.4
        return costs
    if run != ".":
        return costs
    left = at
    while left > start and not text[left - 1].isspace() and text[left - 1] not in HARD:
        left -= 1
    word = text[left:at].lstrip("\"'“„«‹([（¿¡`*_—")
    following = word_after(text, last, end)
    if word in NEVER or word in TITLES:
        costs["abbreviation"] = 0.1
    elif word in MAYBE:
        if word in "дп" and not preceded(text, start, left, "т."):
            costs["initial"] = 0.1
    elif word in NUMBERED:
        if following[:1].isdigit() or (len(word) == 1 and word != "n"):
            costs["abbreviation"] = 0.1
    elif len(word) == 1 and word.isalpha() and unicodedata.category(word) in ("Lu", "Ll"):
        costs["initial"] = 0.1
    elif re.fullmatch(r"(?:[^\W\d]{1,3}\.)+[^\W\d]{1,3}", word) and not re.search(r"[A-Za-z]\.[a-z]{2,3}$", word):
        costs["abbreviation"] = 0.9 if opens(text, last, end) and following[:1].isupper() else 0.1
        if costs["abbreviation"] == 0.9:
            costs["end"] = 0.8
    elif word.isdigit():
        if re.split(r"\W", following, maxsplit=1)[0] in MONTHS:
            costs["ordinal"] = 0.1
        elif len(word) <= 3:
            costs["enumeration"] = 1.5  # a number alone is dear as a sentence, see fragment
    return costs


def preceded(text: str, start: int, at: int, sign: str) -> bool:
    """Whether sign stands before ``at``, white space apart."""
    while at > start and text[at - 1].isspace():
        at -= 1
    return text.endswith(sign, start, at)


def ideographic(text: str, at: int) -> bool:
    """Whether a character is Han, kana or one of their opening marks, which need no space before them."""
    return at < len(text) and bool(re.match(r"[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff「『“《]", text[at]))


@dataclass
class Node:
    """A place where a sentence may end: costs of that reading and of the cheapest other one. A node with ``opened`` ends
    a sentence only if that began at ``opened``."""

    stop: int
    end: float
    other: float
    opened: int = -1


BACK = 4  # a sentence over more nodes than these costs the same wherever it began


def speaks(text: str, start: int, end: int, at: int, close: int, free: bool, another: bool) -> bool:
    """Whether a closed quotation text[at:close + 1] with a final terminator ends its sentence; free: a gap follows,
    another: a further quotation does."""
    stop = close + 1
    c = text[at]
    if c == '"' and not free and ideographic(text, stop):
        return True
    if free:
        return opens(text, stop, end)
    if not another and text[stop] in HARD + SOFT + CLOSERS + ",，、;；:：—":
        return False
    if c in "「『":
        run = re.compile(r"[^\s。、！？「」『』]+").match(text, stop)
        return text[stop] not in "とっ" and path(run[0] if run else "")[0] not in CONTINUES
    if c == "“":
        before = at - 1
        while before >= start and text[before].isspace():
            before -= 1
        sign = text[before] if before >= start else ""
        if ord(text[stop]) < 0x2E80 and not (sign and sign in ":："):
            return False
        return bool(sign) and sign in ":：，," or not SPEAKERS.match(text, stop)
    return False


def terminators(text: str, start: int, end: int) -> list[Node]:
    """The nodes of a paragraph's lattice, from left to right."""
    out: list[Node] = []
    at, last_stop, hellenic, scanned = start, start, -1, start  # the last Greek letter of what has been scanned for one
    spans = {a: (b, quoted) for a, b, quoted in frames(text, start, end)}
    while (sign := SIGN.search(text, at, end)) is not None:
        at = sign.start()
        c = sign[0]
        if at in spans:
            close, quoted = spans[at]
            stop = close + 1
            if text[close - 1] in HARD + SOFT and close - 1 > at and c != "`":
                spaced = stop >= end or text[stop].isspace()
                if quoted and speaks(text, start, end, at, close, spaced, stop in spans):
                    out.append(Node(stop, 0.0, 9.0))
                    last_stop = stop
                elif not quoted and (spaced or ideographic(text, stop)) and opens(text, stop, end):
                    out.append(Node(stop, 0.0, 0.5, at))
            at = stop
            continue
        if c in HARD:
            stop = at
            while stop < end and text[stop] in HARD + SOFT:
                stop += 1
            while stop < end and text[stop] in CLOSERS and stop not in spans:
                stop += 1
            out.append(Node(stop, 0.0, 9.0))
            at = last_stop = stop
            continue
        greek = c == ";" and (at + 1 >= end or text[at + 1].isspace())
        if greek:
            for m in GREEK.finditer(text, scanned, at):
                hellenic = m.end()
            scanned, greek = at, hellenic > last_stop
        if c in SOFT or greek:
            last = at
            while last < end and (text[last] in SOFT + HARD or (greek and last == at)):
                last += 1
            stop = last
            while stop < end and text[stop] in CLOSERS and stop not in spans:
                stop += 1
            if stop >= end:
                out.append(Node(stop, 0.0, 9.0))
            elif text[stop].isspace() or ideographic(text, stop):
                costs = readings(text, start, at, last, end)
                if stop > last:
                    costs = {"end": 1.0} if opens(text, stop, end) else {"end": 9.0, "inside": 0.5}
                out.append(Node(stop, costs.pop("end"), min(costs.values(), default=9.0)))
                if out[-1].end < out[-1].other:
                    last_stop = stop
            at = stop
            continue
        at += 1
    return out


def fragment(text: str, first: int, node: Node) -> float:
    """What a sentence that begins at ``first`` and ends at a node costs beyond the node: bare numbers and single letters
    are marks of what follows, one short word is rarely a sentence."""
    if node.opened >= 0:
        return 0.0 if node.opened == first else 9.0
    if node.stop - first > 12 or node.end == 0.0:
        return 0.0
    core = text[first : node.stop].rstrip(SOFT + CLOSERS)
    if core.isdigit() and len(core) <= 3 and text[node.stop - 1] == ".":
        return 1.0
    return 0.3 if len(core) <= 2 and text[node.stop - 1] == "." else 0.0


def sentences(text: str, start: int, end: int, words: Lexicon = PLAIN) -> list[tuple[int, int]]:
    """The sentences of a paragraph: the cheapest path through the lattice of its terminators, then its gaps."""
    out: list[tuple[int, int]] = []
    span = stripped(text, start, end)
    if not span:
        return out
    start, end = span
    nodes = terminators(text, start, end)
    # ways to have ended: (cost less what the nodes up to there cost unread, first character after, nodes so far, way before)
    ways: list[tuple[float, int, int, tuple | None]] = [(0.0, start, 0, None)]
    read = 0.0  # what the nodes cost so far if none ends a sentence
    for k, node in enumerate(nodes):
        cost, before = min(((w[0] + fragment(text, w[1], node), w) for w in ways), key=lambda x: x[0])
        after = node.stop
        while after < end and text[after].isspace():
            after += 1
        way = (cost + node.end - node.other, after, k, before)
        read += node.other
        recent = [w for w in ways if k - w[2] < BACK]
        old = [w for w in ways if k - w[2] >= BACK]
        ways = ([min(old, key=lambda w: w[0])] if old else []) + recent + [way]
    best: tuple | None = min(ways, key=lambda w: w[0]) if nodes else ways[0]
    cuts: list[int] = []
    while best is not None and best[3] is not None:
        cuts.append(nodes[best[2]].stop)
        best = best[3]
    first = start
    for stop in [*reversed(cuts), end]:
        piece = stripped(text, first, stop)
        if piece:
            out += gaps(text, *piece, words)
        first = stop
    return out


def path(phrase: str, words: Lexicon = PLAIN) -> list[str]:
    """The words of the cheapest path through the dictionary lattice of a phrase; unknown characters
    stand together."""
    n = len(phrase)
    best: list[tuple[float, int]] = [(0.0, 0)] + [(1e9, 0)] * n
    costs = words.costs
    for i in range(n):
        base = best[i][0]
        for j in range(i + 1, min(n, i + words.longest) + 1):
            cost = costs.get(phrase[i:j])
            if cost is None:
                if j > i + 1:
                    continue
                cost = 1.6
            if i == 0 and phrase[i:j] in words.finals and j < n:
                cost += 4  # a final particle opens no phrase
            # a combining vowel or tone never opens a word
            if j < n and unicodedata.combining(phrase[j]):
                cost += 2
            if base + cost < best[j][0]:
                best[j] = (base + cost, i)
    out, j, loose = [], n, False
    while j > 0:
        i = best[j][1]
        if out and j == i + 1 and phrase[i:j] not in costs and loose:
            out[-1] = phrase[i:j] + out[-1]
        else:
            out.append(phrase[i:j])
        loose = j == i + 1 and phrase[i:j] not in costs
        j = i
    return out[::-1] or [""]


def gaps(text: str, start: int, end: int, words: Lexicon = PLAIN) -> list[tuple[int, int]]:
    """A sentence of a script without terminators, cut at those of its spaces that end one."""
    piece = text[start:end]
    if not THAI.search(piece) or not re.search(r"\s", piece):
        return [(start, end)]
    inner = {a: b for a, b, _ in frames(text, start, end)}
    tokens: list[tuple[int, int]] = []
    at = start
    while at < end:
        while at < end and text[at].isspace():
            at += 1
        stop = at
        while stop < end and not text[stop].isspace():
            stop = inner.get(stop, stop) + 1
        if stop > at:
            tokens.append((at, min(stop, end)))
        at = stop
    out: list[tuple[int, int]] = []
    first, seen, told = start, 0, False  # seen: tokens of the phrase with letters of the script; told: it has a verb
    for k in range(1, len(tokens)):
        if THAI.search(text, *tokens[k - 1]):
            told = told or any(w in words.verbs for w in path(text[slice(*tokens[k - 1])], words)[not seen :])
            seen += 1
        left, right = text[slice(*tokens[k - 1])], text[slice(*tokens[k])]
        after = [text[slice(*t)] for t in tokens[k + 1 : k + 3]]
        aside = right[0] in "([（【"
        if aside and not re.search(r"[.!?。！？][)\]）】]$", right):
            continue
        back = k - 1
        while back > 0 and text[tokens[back][0]] in "([（【" and tokens[back][0] > first:
            back -= 1
        spoken = text[slice(*tokens[back])]
        native = seen > 0
        said = path(spoken, words) if THAI.match(spoken[-1:]) else []
        final = bool(said) and bool({"".join(x) for x in ending(said)} & words.finals)
        heard = path(right, words) if THAI.match(right) else [""]
        opened = heard[0] in words.openers or (told and bool(said) and back == k - 1 and clause(heard, words))
        if (native and aside) or (native and opened) or (native and final) or (native and foreign(right, after)) or (not native and THAI.match(right) and bool(re.search(r"[^\x00-\x7fÀ-ɏ]", left[-1:]))):
            out.append((first, tokens[k - 1][1]))
            first, seen, told = tokens[k][0], 0, False
    out.append((first, end))
    return out


def clause(phrase: list[str], words: Lexicon) -> bool:
    """Whether a phrase begins with what may be a subject, and has a verb after it."""
    return len(phrase[0]) > 1 and phrase[0] not in words.carries and phrase[0] not in words.verbs and any(w in words.verbs for w in phrase[1:])


def ending(words: list[str]) -> list[list[str]]:
    return [words[-1:], words[-2:]]


def foreign(right: str, after: list[str]) -> bool:
    """Whether a token after a phrase opens a sentence of another script."""
    core = right.lstrip("\"'“„«‹「『¿¡`")
    if not core or THAI.match(core):
        return False
    letter = next((c for c in core if c.isalpha()), "")
    if letter and not re.match(r"[A-Za-zÀ-ɏ]", letter):
        return not re.match(r"[\d\W]", core)
    latin = re.compile(r"[\"'“„(\[`]*[A-Za-zÀ-ɏ]")
    plain = [bool(re.fullmatch(r"[a-zà-ɏ][a-zà-ɏ']+[,.;:!?]?", w)) for w in after]
    if coded(right) or not core[0].isupper():
        return len(plain) == 2 and all(plain) and (coded(right) or right[0] in "\"“„«¿¡")
    if len(re.match(r"\w+", core)[0]) < 2 and not (plain and plain[0]):
        return False
    if after and after[0][0].isdigit():
        return len(after) > 1 and bool(latin.match(after[1]))
    return bool(after) and len(after[0].strip(".,")) > 1 and bool(latin.match(after[0]))


def phrases(text: str) -> Iterator[tuple[str, bool]]:
    """The phrases of spaceless scripts, and whether each begins a paragraph or line."""
    for m in RUN.finditer(text):
        before = m.start()
        while before > 0 and text[before - 1] in " \t>*-•\"'“‘([":
            before -= 1
        yield m[0], before == 0 or text[before - 1] in "\r\n"


def lexicon(docs: DataFrame, text: str, known: Lexicon | None = None, share: float = SHARE) -> Lexicon:
    """The dictionary of a corpus: the function words known, and the phrases that recur over all documents, each with
    the cost -log of its frequency. Words that begin paragraphs in a like proportion as phrases are opening words.
    A phrase counts if it is at least ``share`` of all phrases (and FEWEST of them), so there are at most 1 / share."""
    known = known or Lexicon()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, bool]] = Counter()
        for batch in batches:
            for t in batch.column(0):
                seen.update(phrases(t.as_py()))
            if len(seen) > 100_000:
                yield counted(seen)
                seen = Counter()
        yield counted(seen)

    def counted(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in seen], pa.string()), pa.array([n * (not s) for (_, s), n in seen.items()], pa.int64()), pa.array([n * s for (_, s), n in seen.items()], pa.int64())], ["phrase", "inside", "starts"])

    spaceless = docs.where(F.col(text).rlike(SPACELESS.pattern)).select(text)
    rows = spaceless.mapInArrow(run, "phrase string, inside bigint, starts bigint").groupBy("phrase").agg(F.sum("inside").alias("inside"), F.sum("starts").alias("starts"))
    rows = cut(rows)
    total = rows.agg(F.sum("inside").alias("inside"), F.sum("starts").alias("starts")).first()
    whole = (total["inside"] or 0) + (total["starts"] or 0)
    if not whole:
        return known
    found = rows.where(F.col("inside") + F.col("starts") >= max(FEWEST, math.ceil(share * whole))).collect()
    costs = dict(known.costs)
    for r in found:
        # a phrase is one word unless it holds a known one
        if not any(w in known.costs for w in path(r["phrase"], known)):
            costs.setdefault(r["phrase"], 1.0 + 0.05 * -math.log((r["inside"] + r["starts"]) / whole))
    words = Lexicon(set(known.finals), set(known.openers), set(known.verbs), set(known.carries), costs)
    begins, others = Counter(), Counter()
    for r in found:
        first = path(r["phrase"], words)[0]
        begins[first] += r["starts"]
        others[first] += r["inside"]
    for w, n in begins.items():
        if len(w) > 1 and n >= FEWEST and w not in words.carries | words.finals and n / max(1, total["starts"]) >= OPENING * others[w] / max(1, total["inside"]):
            words.openers.add(w)
    return words


def sentence_units(docs: DataFrame, item: str = "doc_id", text: str = "text", layout: str = "layout", known: Lexicon | None = None) -> DataFrame:
    """(item, start_char, end_char) of the units of every document. known: function words of spaceless scripts."""
    kind = docs.schema[item].dataType.simpleString()
    words = lexicon(docs, text, known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, ends = [], [], []
            for key, t, form in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                for a, b in units(t.as_py(), form, words):
                    ids.append(key)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["id", "start_char", "end_char"])

    sent = docs.where(F.length(text) > 0).select(F.col(item).alias("id"), text, layout)
    return sent.mapInArrow(run, f"id {kind}, start_char bigint, end_char bigint").withColumnRenamed("id", item)

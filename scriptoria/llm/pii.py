"""Personal information in free text: labellers vote, expectation-maximisation weighs them, a classifier decides.

1. Wide patterns propose spans per kind. Labellers of three sorts vote on each span (+1, -1, or 0 to abstain): regular
   expressions for its form, gazetteers for its words, context words before and after it.
2. Spans are counted by kind and vote pattern over all documents; the patterns (at most 3**labellers a kind) are all
   that reaches the driver. EM over them estimates how reliable each labeller is and the posterior of each pattern.
3. A logistic span classifier per kind is trained on those posteriors, on about ``train_rows`` spans a kind (chosen by
   hash; a documented bound), with the votes, the span's form and the words around it as features. It scores every
   span of every document; accepted spans are freed of overlaps, leftmost first, then longest.

Documents are processed whole, one row per document from the scan to the result, without a shuffle. Redaction carries
the text along with the spans, so the corpus is read once.

The words the labellers go by are general ones for each kind; none stems from a corpus. Names are told by letters of
any Latin alphabet; Chinese ones by family name, after a word that announces a person.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.sampling import hash_sample
from scriptoria.session import store

KINDS = ("email", "phone", "id_number", "address", "person")
WIDTH = 4096
SPANS = "array<struct<kind:int,start:int,end:int,votes:array<tinyint>,feats:array<int>>>"

# Words and forms the labellers go by.
SIGN = "@＠﹫"  # as typed, full width, small form
AT = rf"(?:[{SIGN}]|\s?[(\[]at[)\]]\s?|\s(?:AT|at)\s)"
DOT = r"(?:\.|\s?[(\[]dot[)\]]\s?|\s(?:DOT|dot)\s)"
EMAIL = re.compile(rf"(?<![\w.+%-])[A-Za-z0-9][\w.+%-]*{AT}[A-Za-z0-9-]+(?:{DOT}[A-Za-z0-9-]+)+", re.ASCII)
EMAIL_FORM = re.compile(rf"[A-Za-z0-9][\w.+%-]*{AT}(?:[A-Za-z][A-Za-z0-9-]*{DOT})+[A-Za-z]{{2,}}", re.ASCII)
TLDS = frozenset("com org net edu gov int info biz name io dev app de fr uk cn eu us example test invalid local".split())
FILES = frozenset("png jpg jpeg gif svg webp md txt json yaml yml csv pdf html js css py xml zip".split())
DIGITS = re.compile(rf"(?<![\w.{SIGN}/#-])(?:\+\d|\(\d|\d)[\d ()/.-]{{5,}}\d(?!\w)(?:\s?(?:ext\.?|x|Durchwahl|poste)\s?\d{{1,5}}\b)?")
PHONE_FORM = re.compile(r"(?:\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,6}|\(\d{2,5}\)[ .-]?\d{3}[ .-]?\d{4}|0\d{1,4}(?:[ /-]\d{2,5}){2,5}|0\d{2,5}/\d{3,8}(?:-\d{1,4})?)(?:\s?(?:ext\.?|x|Durchwahl|poste)\s?\d{1,5})?")
ID = re.compile(rf"(?<![\w{SIGN}/#.-])(?:\d{{3}}-\d{{2}}-\d{{4}}|\d{{4}} \d{{4}} \d{{3,4}}|\d{{8}}-\d{{4}}|\d{{17}}[\dXx]|[A-Z]{{2}} ?\d{{2}} ?\d{{2}} ?\d{{2}} ?[A-D]|[A-Z]{{1,2}}\d{{7,8}}|\d{{9,12}})(?![\w-])")
ID_FORM = re.compile(r"\d{3}-\d{2}-\d{4}|\d{4} \d{4} \d{3}|\d{8}-\d{4}|\d{17}[\dXx]|[A-Z]{2}(?: \d{2}){3} [A-D]|[A-Z]{2}\d{6}[A-D]|[A-Z]{1,2}\d{7,8}")
CAP = r"[A-ZÄÖÜÉ][a-zäöüßéèêàç]+"
ROAD = r"(?:St|Ave|Rd|Ln|Blvd|Dr|Street|Avenue|Road|Lane|Boulevard|Drive|Way|Court|Close|Terrace|Square|Row|Gardens)"
ADDRESS = re.compile(
    rf"(?<![\w.,-])\d{{1,5}}[a-z]? (?:{CAP} ){{1,3}}{ROAD}\b\.?(?:,? (?:Unit|Apt|Suite|Flat)\.? \d+[A-Za-z]?)?(?:,\s?{CAP}|\n{CAP})?(?: [A-Z]{{1,2}}\d{{1,2}}[A-Z]? \d[A-Z]{{2}})?"
    rf"|(?<!\w){CAP}(?:straße|strasse|weg|gasse|platz|allee|ring|damm|ufer)\s\d{{1,4}}\s?[a-z]?(?:,\s?(?:\d{{5}}\s)?{CAP})?"
    rf"|(?<![\w.])\d{{1,4}}(?: ?(?:bis|ter))?,? (?:rue|avenue|boulevard|place|chemin|impasse|quai|allée|cours) (?:(?:de la|de|du|des|d’|d'|l')\s?)?{CAP}(?:[ -]{CAP})?(?:,\s?(?:\d{{5}}\s)?{CAP})?"
    r"|(?<![一-鿿])[一-鿿]{2,12}?(?:省|市)(?:[一-鿿]{1,4}区)?[一-鿿]{1,6}(?:路|街|道|巷|大街)\d{1,5}(?:号|弄)(?:\d+(?:室|楼|单元|栋))*"
)
ADDRESS_LEAD = re.compile(r"[一-鿿]*(?:到|往|址|在|于|给|是|为)(?=[一-鿿]{2,3}(?:省|市))")
# Upper and lower case letters of the Latin alphabets, by rule.
UPPER, LOWER = ("".join(chr(n) for n in range(0x250) if unicodedata.category(chr(n)) == c) for c in ("Lu", "Ll"))
NAME = rf"(?:[{UPPER}](?:['’][{UPPER}])?[{LOWER}]{{2,}}|[{UPPER}]{{3,}})"
PERSON = re.compile(rf"(?<![\w{SIGN}./-])(?=({NAME}(?:-{NAME})?, {NAME}|{NAME} (?:[{UPPER}]\. )?{NAME}(?:-{NAME})?|[{UPPER}]\. {NAME}(?:-{NAME})?)(?![\w{SIGN}]))")
# The commonest Chinese family names.
HAN_FAMILY = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
HAN_PERSON = re.compile(rf"(?:联系人|作者|签名|审阅人|负责人|记录人|姓名|收件人)\s?[:：|]\s*([{HAN_FAMILY}][一-鿿]{{1,2}})(?![一-鿿])")
LEADS = {
    "email": r"(?:mail|email|e-mail|reply-to|邮箱|邮件|via|[ÀàÉé]crire à|an|write to|contact|courriel|cc|from|to)\s?[:：|]?\s*[(<\[]?$|[(<]$",
    "phone": r"(?:tel|phone|t[ée]l[ée]phone|mobile?|whatsapp|call|fax|telefon|ring|电话|手机|portable|cell)\.?\s?[:：|]?\s*$",
    "id_number": r"(?:ssn|security(?: number)?|nino|insurance(?: no\.?| number)?|ni number|passport(?: no\.?)?|reisepass|ausweis(?:nummer)?|identit[ée]|national id|personal number|personnummer|身份证(?:号)?|护照(?:号)?|id(?: no\.?| number)?|no\.|number)\s?[:：|]?\s*$",
    "address": r"(?:address|adresse|anschrift|office|lives at|地址|寄到|住在|(?:deliver|ship|send|post)(?:s|ed|ped)?\b[^.\n]{0,20} to|located at|domicile)\s?[:：|]?\s*$",
    "person": r"(?:according to|(?:interview|meeting|call|talk) with|yesterday|today|(?:reviewed|written|approved|prepared) by|signed,|sincerely,|regards,|r[ée]dig[ée] par|author:|contact:|ansprechpartner:|cc:|联系人：|dr\.|mr\.?|mrs\.?|ms\.?|frau|herr|prof\.|m\.|mme)\s*$",
}
LEADS = {k: re.compile(v, re.IGNORECASE) for k, v in LEADS.items()}
TRAPS = {
    "email": re.compile(r"(?:icon|image|file|package)\s*$", re.IGNORECASE),
    "phone": re.compile(r"(?:range|ticket \S*|build|version|page|rows|between|lines|commit|\d{4}-\d\d-\d\d|isbn|issn|port|kb-?)\s*$", re.IGNORECASE),
    "id_number": re.compile(r"(?:range|ticket \S*|build|version|page|tel\.?|phone|call|mobile?|whatsapp|fax|telefon|电话：?|手机：?|isbn|issn)\s?[:：|]?\s*$", re.IGNORECASE),
    "address": re.compile(r"(?:page|figure|table|section|row)\s*$", re.IGNORECASE),
    "person": re.compile(r"(?:the|of|an?|icon|file|ticket)\s*$", re.IGNORECASE),
}
# What a person does: a verb in the past (by its ending, or a common irregular one) or a plan.
FOLLOWS = re.compile(r"^,?\s(?:(?:has |had |was |will )?[a-z]{2,}ed|gave|said|says|wrote|writes|told|sent|took|made|came|went|left|met|spoke|thinks|will|and I)\b")
FOLLOWS_TRAP = re.compile(r"^\s(?:index|server|bot|build|release|branch|module|service|package|library|tool|script|version|v?\d)\b", re.IGNORECASE)
COMMON = frozenset(
    "the a an when while why if it its our we they nobody somebody everybody two three each keep compare do does don between with without after before because of in on at for from to and or not but this that these those there here "
    "yesterday today tomorrow according interview meeting reviewed signed author contact call reach office address adresse no yes please thanks dear hello "
    "der die das ein eine für wenn über und oder nicht von le la les un une des du de ça lorsqu après il elle dans pour avec sans dr mr mrs ms prof frau herr street road lane avenue unit "
    "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december".split()
)


class Gazetteer:
    """Known name parts and what they have in common: first and last letters."""

    def __init__(self, given: list[str], family: list[str]) -> None:
        self.given, self.family = frozenset(given), frozenset(family)
        self.heads = {"given": frozenset(x[:3] for x in given), "family": frozenset(x[:3] for x in family)}
        self.tails = {"given": frozenset(x[-3:] for x in given), "family": frozenset(x[-3:] for x in family)}

    def like(self, word: str, part: str) -> bool:
        return len(word) > 3 and word[:3] in self.heads[part] and word[-3:] in self.tails[part]

    def fragment(self, local: str) -> bool:
        """Does a mail address name somebody? Any run of letters like a known name, perhaps after an initial."""
        for run in re.findall(r"[a-z]{4,}", local.lower()):
            for x in (run, run[1:]):
                if self.like(x.capitalize(), "given") or self.like(x.capitalize(), "family"):
                    return True
        return False


def _shape(s: str) -> str:
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", "x", re.sub(r"[A-Z]", "X", re.sub(r"\d", "9", s))))


def _features(kind: str, text: str, a: int, b: int, votes: list[int]) -> list[int]:
    left, right = re.findall(r"\w+|[^\w\s]", text[max(0, a - 24) : a])[-2:], re.findall(r"\w+|[^\w\s]", text[b : b + 24])[:2]
    names = [f"v{i}={v}" for i, v in enumerate(votes)]
    names += [f"shape={_shape(text[a:b])[:40]}", f"len={min(12, (b - a) // 3)}", "l1=" + (left[-1].lower() if left else ""), "l2=" + " ".join(left).lower(), "r1=" + (right[0].lower() if right else "")]
    return sorted({zlib.crc32(f"{kind} {n}".encode()) % WIDTH for n in names})


def _sign(yes: bool, no: bool = False) -> int:
    return 1 if yes else -1 if no else 0


def _person_votes(text: str, a: int, b: int, g: Gazetteer) -> list[int]:
    words = [w if w[1:].islower() else w.capitalize() for w in re.findall(rf"{NAME}|[A-Z](?=\.)", text[a:b])]
    comma = ", " in text[a:b]
    full = [w for w in words if len(w) > 1]
    hyphen = text[a:b].count("-")
    if comma:
        family, given = full[: 1 + hyphen], full[1 + hyphen :]
    else:
        family, given = (full[-1 - hyphen :], full[: -1 - hyphen]) if hyphen else (full[-1:], full[:-1])
    return [
        _sign(any(w in g.family for w in family), all(w in g.given for w in family)),
        _sign(any(w in g.given for w in given), bool(given) and all(w in g.family for w in given)) if given else 0,
        _sign(all(g.like(w, "family") for w in family), True),
        _sign(all(g.like(w, "given") for w in given), True) if given else 0,
        _sign(bool(LEADS["person"].search(text[max(0, a - 24) : a])), bool(TRAPS["person"].search(text[max(0, a - 12) : a]))),
        _sign(bool(FOLLOWS.search(text[b : b + 16])), bool(FOLLOWS_TRAP.search(text[b : b + 12]))),
    ]


def _context(kind: str, text: str, a: int) -> tuple[int, int]:
    before = text[max(0, a - 32) : a]
    return _sign(bool(LEADS[kind].search(before))), -1 if TRAPS[kind].search(before) else 0


def propose(text: str | None, g: Gazetteer) -> list[tuple[int, int, int, list[int], list[int]]]:
    """(kind, start, end, votes, features) of all candidate spans; offsets are code points."""
    if not text:
        return []
    found = []

    def add(kind: str, a: int, b: int, votes: list[int]) -> None:
        found.append((KINDS.index(kind), a, b, votes, _features(kind, text, a, b, votes)))

    if any(c in text for c in SIGN) or "at" in text or "AT" in text:
        for m in EMAIL.finditer(text):
            a, b, s = m.start(), m.end(), m.group()
            last = re.split(r"[^A-Za-z0-9]+", s)[-1].lower()
            lead, trap = _context("email", text, a)
            add("email", a, b, [_sign(bool(EMAIL_FORM.fullmatch(s)), True), _sign(last in TLDS, True), lead, min(trap, -1 if last in FILES or last.isdigit() else 0), _sign(g.fragment(re.split(AT, s)[0]))])
    for m in DIGITS.finditer(text):
        a, b, s = m.start(), m.end(), m.group()
        digits = sum(c.isdigit() for c in s)
        lead, trap = _context("phone", text, a)
        add("phone", a, b, [_sign(bool(PHONE_FORM.fullmatch(s)), True), lead, trap, -1 if ID_FORM.fullmatch(s) else 0, _sign(9 <= digits <= 16, True)])
    for m in ID.finditer(text):
        a, b, s = m.start(), m.end(), m.group()
        lead, trap = _context("id_number", text, a)
        add("id_number", a, b, [_sign(bool(ID_FORM.fullmatch(s)), True), lead, trap, -1 if PHONE_FORM.fullmatch(s) else 0, _sign(any(c.isalpha() for c in s))])
    for m in ADDRESS.finditer(text):
        a, b, s = m.start(), m.end(), m.group()
        if cue := ADDRESS_LEAD.match(s):
            a, s = a + cue.end(), s[cue.end() :]
        lead, trap = _context("address", text, a)
        town = bool(re.search(rf"(?:,\s?|\n)(?:\d{{5}}\s)?(?:Unit \d+|{CAP})|号", s))
        post = bool(re.search(r"\b\d{5}\b|[A-Z]{1,2}\d{1,2}[A-Z]? \d[A-Z]{2}|市", s))
        add("address", a, b, [_sign(town), lead, trap, _sign(post), _sign(not s[-1].isspace(), True)])
    for m in PERSON.finditer(text):
        a, b = m.start(1), m.end(1)
        # A function word with a capital opens a sentence; it is no part of a name.
        if COMMON.isdisjoint(re.findall(r"\w{2,}", m.group(1).lower())):
            add("person", a, b, _person_votes(text, a, b, g))
    for m in HAN_PERSON.finditer(text):
        # Announced, and of a known family name; what the other labellers go by does not apply.
        add("person", m.start(1), m.end(1), [1, 0, 1, 0, 1, 0])
    return found


def candidates(docs: DataFrame, key: str, text: str, g: Gazetteer, keep_text: bool = False) -> DataFrame:
    """(key, spans): one row per document with at least one candidate span; with ``keep_text`` all documents and their text."""
    kind = docs.schema[key].dataType.simpleString()
    struct = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("votes", pa.list_(pa.int8())), ("feats", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                made = [propose(t, g) for t in part.column(1).to_pylist()]
                keep = pa.array([i for i, x in enumerate(made) if x or keep_text], pa.int64())
                spans = pa.array([[dict(zip(("kind", "start", "end", "votes", "feats"), s)) for s in x] for x in made if x or keep_text], pa.list_(struct))
                whole = [part.column(1).cast(pa.string())] if keep_text else []
                yield pa.RecordBatch.from_arrays([part.column(0).take(keep), spans, *whole], ["key", "spans", "text"][: 2 + keep_text])

    return docs.select(docs[key], docs[text]).mapInArrow(run, f"key {kind}, spans {SPANS}" + ", text string" * keep_text)


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> tuple[dict[tuple[int, ...], float], np.ndarray, float]:
    """EM over vote patterns of one kind: posterior of each pattern, P(vote | truth) per labeller, share of true spans.

    Starts from the sign of the votes' sum; a count of one of every outcome keeps estimates inside (0, 1).
    """
    votes = np.array([p for p, _ in patterns], dtype=np.int64)
    n = np.array([c for _, c in patterns], dtype=np.float64)
    post = np.where(votes.sum(axis=1) > 0, 0.9, 0.1)
    table = np.zeros((2, votes.shape[1], 3))
    share = 0.5
    for _ in range(rounds):
        share = float((post * n).sum() / n.sum())
        for y, w in ((0, (1 - post) * n), (1, post * n)):
            for v in (-1, 0, 1):
                table[y, :, v + 1] = ((votes == v) * w[:, None]).sum(axis=0) + 1.0
            table[y] /= table[y].sum(axis=1, keepdims=True)
        log = [math.log(max(s, 1e-9)) + np.log(table[y][np.arange(votes.shape[1])[None, :], votes + 1]).sum(axis=1) for y, s in ((0, 1 - share), (1, share))]
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
    return dict(zip((p for p, _ in patterns), post.tolist())), table, share


def train(rows: list[tuple[list[int], float]], rounds: int = 300) -> np.ndarray:
    """Logistic regression on sparse binary features and soft labels: weights, then the intercept."""
    w = np.zeros(WIDTH + 1)
    if not rows:
        return w
    size = np.array([len(f) for f, _ in rows])
    flat = np.concatenate([np.asarray(f, dtype=np.int64) for f, _ in rows])
    owner = np.repeat(np.arange(len(rows)), size)
    y = np.array([p for _, p in rows])
    scale = np.zeros(WIDTH + 1)
    for _ in range(rounds):
        z = np.bincount(owner, w[flat], len(rows)) + w[-1]
        err = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - y
        grad = np.r_[np.bincount(flat, err[owner], WIDTH), err.sum()] / len(rows) + 1e-5 * w
        scale += grad**2
        w -= 0.3 * grad / np.sqrt(scale + 1e-12)
    return w


def fit(spans: DataFrame, train_rows: int) -> np.ndarray:
    """Weights of the span classifier of each kind."""
    one = spans.select("key", F.explode("spans").alias("s")).select("key", "s.*")
    counted = one.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()
    weights = np.zeros((len(KINDS), WIDTH + 1))
    for k in range(len(KINDS)):
        patterns = sorted((tuple(r["votes"]), r["n"]) for r in counted if r["kind"] == k)
        if not patterns:
            continue
        post, _, _ = reliabilities(patterns)
        own = one.where(F.col("kind") == k)
        sample = hash_sample(own, ["key", "start"], train_rows, sum(n for _, n in patterns), "spans").orderBy("key", "start")
        weights[k] = train([(r["feats"], post[tuple(r["votes"])]) for r in sample.select("votes", "feats").collect()])
    return weights


def _fitted(docs: DataFrame, key: str, text: str, names: DataFrame, train_rows: int, keep_text: bool) -> tuple[DataFrame, np.ndarray]:
    known = names.select("name_part", "part_kind").where("name_part IS NOT NULL").distinct().collect()
    g = Gazetteer([r[0] for r in known if r[1] == "given"], [r[0] for r in known if r[1] == "family"])
    spans = store(candidates(docs, key, text, g, keep_text))
    return spans, fit(spans, train_rows)


def accepted(spans: list[dict], weights: np.ndarray) -> list[dict]:
    """The spans the classifier takes, freed of overlaps."""
    good = [s for s in spans if weights[s["kind"]][s["feats"]].sum() + weights[s["kind"]][-1] > 0]
    good.sort(key=lambda s: (s["start"], -s["end"], s["kind"]))
    taken, end = [], -1
    for s in good:
        if s["start"] >= end:
            taken.append({"kind": KINDS[s["kind"]], "start_pos": s["start"], "end_pos": s["end"]})
            end = s["end"]
    return taken


def mentions(docs: DataFrame, key: str, text: str, names: DataFrame, train_rows: int = 12_000) -> DataFrame:
    """(key, mentions array<struct<kind, start_pos, end_pos>>) of documents with at least one mention.

    ``names`` (name_part, part_kind) is the gazetteer, a table of fixed size. Null and empty texts have no mention;
    a document of any length is read whole. Without names the other labellers decide.
    """
    spans, weights = _fitted(docs, key, text, names, train_rows, False)
    struct = pa.struct([("kind", pa.string()), ("start_pos", pa.int32()), ("end_pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            taken = [accepted(row, weights) for row in b.column(1).to_pylist()]
            keep = pa.array([i for i, x in enumerate(taken) if x], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), pa.array([x for x in taken if x], pa.list_(struct))], ["key", "mentions"])

    kind = docs.schema[key].dataType.simpleString()
    return spans.mapInArrow(run, f"key {kind}, mentions array<struct<kind:string,start_pos:int,end_pos:int>>")


def redacted(docs: DataFrame, key: str, text: str, names: DataFrame, train_rows: int = 12_000) -> DataFrame:
    """(key, text): typed placeholders in the mentions' stead, all else unchanged; null text stays null. One row per row of ``docs``."""
    spans, weights = _fitted(docs, key, text, names, train_rows, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row, whole in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                made, at = [], 0
                for m in accepted(row, weights):
                    made += [whole[at : m["start_pos"]], f"[{m['kind'].upper()}]"]
                    at = m["end_pos"]
                out.append("".join([*made, whole[at:]]) if made else whole)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["key", "text"])

    return spans.select("key", "spans", "text").mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, text string")

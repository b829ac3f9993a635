"""Secret scan: fixed patterns, and zstandard novelty for what no pattern knows.

Novelty: a candidate is a run of key-like characters of more than one kind (lower case, upper
case, digits), not a plain or capitalised word, with a sensitive word near on either side. Its
marginal size is what it adds to the compressed text around it, when the compressor is primed
with a dictionary of common identifiers' words. Both are taken apart at changes of case, digits
and separators and lower-cased first, so compounds of known words, of the dictionary or of the
surrounding code, cost little however they are joined; a random key falls into pieces that are
found nowhere. What a frame costs by itself depends on the place, so the measure is set against
random strings of the same length and kinds of characters in the same place: a candidate that
costs LEAST_SHARE of what they cost is reported as ``novel``.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import nested, recounted, steps

KINDS = ("assign", "access", "hex", "novel")
# The base patterns and their least lengths.
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
LEAST_VALUE = 6
#: Words that make a place sensitive, how far from a candidate they may be, and how much text around it counts (code points on each side).
_SENSITIVE = re.compile(r"(?i:pass|pwd|secret|token|key|auth|bearer|credential|private|signature|salt|cookie|session)", re.ASCII)
REACH, AROUND = 40, 512
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{10,}={0,2}", re.ASCII)
_KINDS_OF = (re.compile("[a-z]"), re.compile("[A-Z]"), re.compile("[0-9]"))
_WORD = re.compile("[A-Z][a-z]+|[A-Z][a-z]+[-/][A-Z]?[a-z]+")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+|[^A-Za-z0-9\s]+|\s+")
#: Share of the mean marginal bytes of CONTROLS random strings from which a candidate is reported. Measured on random keys: 0.75 or more, 0.86 or more for 95 in 100; on compounds with a quarter of their words unknown: mostly 0.35 to 0.8.
LEAST_SHARE, CONTROLS = 0.85, 3
#: Goes before the surroundings, so that a frame has literals and matches even where these are empty.
_FILLER = "qz jx value name kw config list vbn data "
#: Words of common identifiers, by which the compressor is primed.
_IDENTIFIERS = """
set value name id key data list test file path user is has get on to of by in new old all max min num count total size
access account action active adapter address admin agent alert alias allow amount android api app application archive argument array asset async attribute audit auth author auto available average
back background backup balance base batch bean begin binary bind bit block blob body bool border bottom box branch bucket buffer build builder bundle button byte
cache call callback cancel capacity card cart case catalog category cell center certificate chain change channel char chart check child choice class clean clear click client clone close cloud cluster code codec collection color column command comment commit common compare complete component compute condition config configuration confirm connect connection console constant constructor consumer contact container content context control controller convert cookie copy core count country create credential currency current cursor custom customer
daemon dashboard data database date day debug decode default define delay delete delta demo depth description design device dialog dict digest directory disable discount disk dispatch display document domain done double down download draft driver duration dynamic
edge edit editor element email empty enable encode encoding encrypt end endpoint engine entity entry enum environment error escape event example exception exchange execute executor exist exit expire export expression extend extension external extra
factory fail failure false family feature fetch field file fill filter final find first fix flag flat flex float flow flush folder font footer force foreign form format forward found frame framework free from front full function functions future
gateway general generate generator generic global grant graph grid group guard guest guide
handle handler hash header health height hello help hidden high history home hook host hour html http https
icon identifier identity image implement import include index info init initial inner input insert instance integer interface internal interval invalid invoice invoke item iterator
java job join json
kernel keyword kind
label lambda language large last latest layer layout leaf left legacy length level library license limit line link listen listener literal load loader local locale location lock log logger login logout long lookup loop lower
machine main make manage manager map mapper mapping margin mark mask master match math matrix measure media member memory menu merge message meta metadata method metric micro middle migration minute mobile mock mode model modify module monitor month mount move multi mutex
namespace native navigation nested network next node none normal notify null number
object observer offset online open operation operator option order org organization origin output overlay override owner
package packet page panel parallel param parameter parent parse parser partial partition pass password patch path pattern pause payload payment pending percent permission persist person phone photo picker pipeline pixel place platform player plugin point policy poll pool popup port position post prefix prepare preview previous price print priority private process processor producer product production profile program progress project promise property protected protocol provider proxy public publish pull push
quality query queue quick quota
random range rank rate read reader ready real reason receive record recover redirect reducer reference refresh region register registry relation release reload remote remove render repair repeat replace reply report repository request require reserve reset resize resolve resource response rest restart restore result resume retry return reverse review revision right role rollback root rotate route router row rule run runtime
safe sample save scale scan schedule schema scope score screen script scroll search second secret section secure security segment select selector send sender sequence serial series server service session setting setup shadow shape share shared shell shift short show shutdown sign signal signature simple single site skip sleep slice slot small snapshot socket sort sorted source space span spark special spec split sql stack stage standard start state statement static station status step stop storage store stream string strip strong struct style submit subscribe success suffix summary super support suspend switch symbol sync syntax system
table tag target task team template temp temporary tenant term test text theme thread threshold throw tick time timeout timer timestamp title toggle token tool top topic total trace track trade traffic train transaction transfer transform translate tree trigger trim true try tuple type
unique unit update upgrade upload upper url usage user username util utils uuid
valid validate validation value variable vector vendor verify version video view virtual visible visit volume
wait walk wallet warning watch web week weight widget width window wire word work worker workflow workspace wrapper write writer
xml yaml year zone zip com org net apache google github example www
0123456789 2019 2020 2021 2022 2023 2024 2025 2026 01 02 03 10 12 100 123 1234 12345 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ
"""


@lru_cache(maxsize=1)
def _compressor() -> zstandard.ZstdCompressor:
    primed = (" ".join(_IDENTIFIERS.split()) + " ").encode()
    found = zstandard.ZstdCompressionParameters.from_level(16, dict_size=len(primed), source_size=4 * AROUND, min_match=3, write_content_size=False, write_checksum=False)
    return zstandard.ZstdCompressor(compression_params=found, dict_data=zstandard.ZstdCompressionDict(primed, dict_type=zstandard.DICT_TYPE_RAWCONTENT))


def taken_apart(text: str) -> str:
    """Words, numbers and separators of identifiers, in lower case, parted by spaces."""
    return " ".join([x.lower() for x in _PART.findall(text) if not x.isspace()])


def _added(around: str, candidates: list[str]) -> list[int]:
    """Compressed bytes that each candidate adds to what is around it."""
    size = lambda x: len(_compressor().compress(x.encode()))
    alone = size(around)
    return [size(f"{around} {taken_apart(c)}") - alone for c in candidates]


def novelty(before: str, candidate: str, after: str) -> float:
    """Marginal bytes of a candidate in its surroundings (in which it doesn't count if it occurs there too), as a share of those of random strings."""
    around = _FILLER + taken_apart(f"{before} {after}".replace(candidate, " "))
    used = "".join(kind for kind in (string.ascii_lowercase, string.ascii_uppercase, string.digits) if not set(kind).isdisjoint(candidate))
    drawn = random.Random(candidate)  # the same for the same candidate
    own, *others = _added(around, [candidate, *("".join(drawn.choices(used, k=len(candidate))) for _ in range(CONTROLS))])
    return own * CONTROLS / max(1, sum(others))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    return out + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def _joined(spans: list[tuple[int, int, str]]) -> tuple[list[int], list[int]]:
    """Begins and ends of the spans' union, in order."""
    begins, ends = [], []
    for a, b, _ in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            begins.append(a), ends.append(b)
    return begins, ends


def novel_spans(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Candidates that no taken span covers whole and whose marginal bytes reach the limit; in time linear in the text."""
    if not _SENSITIVE.search(text):
        return []
    begins, ends = _joined(taken)
    words = [m.span() for m in _SENSITIVE.finditer(text)]
    out, w = [], 0
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        if sum(k.search(m[0]) is not None for k in _KINDS_OF) < 2 or _WORD.fullmatch(m[0]):
            continue
        while w < len(words) and words[w][0] < a - REACH:
            w += 1
        k = w  # from here on words begin at most REACH before; those inside the candidate don't count
        while k < len(words) and words[k][1] > a and words[k][0] < b:
            k += 1
        if k == len(words) or words[k][1] > b + REACH:
            continue
        k = bisect_right(begins, a) - 1
        if k >= 0 and b <= ends[k]:
            continue
        if novelty(text[max(0, a - AROUND) : a], m[0], text[b : b + AROUND]) >= LEAST_SHARE:
            out.append((a, b, "novel"))
    return out


def listed(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end by start, then kind, joined by commas."""
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]))))


def masked(text: str, spans: list[tuple[int, int, str]], mask: str) -> str:
    """The text with each run of overlapping spans replaced by the mask."""
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans`` for each row of ``docs(doc_id, text, ...)``.

    Places are code points, ends exclusive; spans lists all of them. A null text is an empty
    one, without spans. Null doc_id stays null, repeated rows are kept, other columns are
    unused, an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            counts, digests, lists = [[], [], [], []], [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                spans = base + novel_spans(text or "", base)
                for n, kind in zip(counts, KINDS):
                    n.append(sum(k == kind for *_, k in spans))
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                lists.append(listed(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(n, pa.int64()) for n in counts), pa.array(digests), pa.array(lists)], ["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")


def mask_secrets(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """All rows and columns of docs, with every span replaced by the mask in text, and n_chars (where there is such a column) counted anew for changed texts. A null text stays null."""
    rows = nested(docs).select("row", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            texts, changed = [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                spans = base + novel_spans(text or "", base)
                texts.append(masked(text, spans, mask) if spans else text)
                changed.append(bool(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(changed)], ["row", "text", "changed"])

    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType()), T.StructField("changed", T.BooleanType())])
    return recounted(rows.mapInArrow(run, schema), docs, "changed")

"""Secret scan: candidates judged by a random forest.

Candidates are runs of at least MIN_RUN characters of [A-Za-z0-9+/_-] with a letter or
digit, values of at least MIN_VALUE characters that are assigned to a name with a secret
word in it (with spaces where they are quoted), passwords inside URLs, and blocks of armoured
keys and certificates; candidates that overlap are one.
A random forest on candidate length, character transitions, dictionary coverage, path
and neighbouring words, trained from labelled findings, removes false positives: also
data URIs, public keys, integrity hashes and ids in URLs. The
forest is fitted with MLlib and scored next to the text, so no finding has to be joined
back to its document.

Defined cases: null or empty text has no findings; a null path counts as empty; a text
of any length is scanned whole, within one task; repeated rows are scanned each; a score
of exactly `least` is a secret; extra columns are ignored; empty tables give an empty
result. Positions count characters.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T

MIN_RUN, MIN_VALUE = 16, 6
#: Bytes before and behind a candidate in which neighbouring words are looked for.
CONTEXT = 96
TREES, DEPTH = 40, 10
#: Bound of the labelled findings that a forest is fitted on.
FINDINGS = 9000

_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), 0x2B, 0x2F, 0x5F, 0x2D]] = True
_CLASS = np.full(256, 4, np.int8)
_CLASS[0x30:0x3A], _CLASS[0x41:0x5B], _CLASS[0x61:0x7B] = 0, 1, 2
_CLASS[[0x2B, 0x2F, 0x5F, 0x2D]] = 3

#: Words that tell about a candidate.
DICTIONARY = "access account admin api app auth base bearer build cache client code commit config credential data default demo dev dummy example file hash host http https image index info item key license local mail main name null number order page password path private public release request sample secret server service session source string system table temp test text token type update user value version world your".split()
SECRET_WORDS = "secret token key apikey api_key password passwd passphrase pwd auth bearer credential credentials private access".split()
OTHER_WORDS = "commit sha sha1 sha256 md5 hash checksum digest revision uuid guid id order card phone number isbn invoice build version image etag".split()
PATH_WORDS = "test tests example examples sample samples fixture fixtures docs doc mock demo".split()
#: How keys of well-known services begin.
PREFIXES = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghs_", "ghu_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "xoxa-", "xoxs-", "sk-", "sk_live_", "sk_test_", "rk_live_", "pk_live_", "npm_", "pypi-", "hf_", "eyJ", "dop_v1_", "shpat_")

_NAME = re.compile(rb"(?i)(?:secret|token|passw|passphrase|pwd|api.?key|access.?key|private.?key|auth|credential)[a-z0-9_.\-]{0,20}[\"'`\]]{0,2}[ \t]{0,3}$")
_VALUE = re.compile(rb"[=>]?[ \t]{0,3}(?:(?:bearer|basic|token)[ \t]+)?[\"'`]?([^\s\"'`]{%d,})" % MIN_VALUE, re.IGNORECASE)
_QUOTED = re.compile(rb"[=>]?[ \t]{0,3}([\"'`])([^\"'`\r\n]{%d,200})\1" % MIN_VALUE)
_LOGIN = re.compile(rb"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s/@:\"']{0,80}:([^\s/@\"']{4,200})@")
_BLOCK = re.compile(rb"-----BEGIN [A-Z0-9 ]+-----")
_BLOCK_END = re.compile(rb"-----END [A-Z0-9 ]+-----")

#: Whole keys of well-known services.
_FORMS = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|github_pat_\w{60,}|AIza[\w-]{35}|xox[abps]-[\w-]{20,}|[sr]k_live_[A-Za-z0-9]{20,}|glpat-[\w-]{20}|npm_[A-Za-z0-9]{36}|hf_[A-Za-z0-9]{30,}")
_IN_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s\"'<>]*$")
_DATA = re.compile(r"(?i)(?:data:[\w./+;=-]*|base64),\s*$")
_PUBLIC = re.compile(r"(?i)(?:ssh-(?:rsa|ed25519|dss)|ecdsa-[\w-]+|public.?key\S{0,4}|integrity\S{0,3}|checksum\S{0,3}|digest\S{0,3})\s*[\"']?\s*$")
_SUM = re.compile(r"sha(?:1|256|384|512)-[A-Za-z0-9+/]+")
_PASS = re.compile(r"(?i)(?:passw|passphrase|pwd)[\w.-]*[\"'`\]]*\s*[:=]?[=>]?\s*[\"'`]?$")

FEATURES = ["length", "class_changes", "digit_share", "upper_share", "letter_share", "entropy", "hex_only", "digits_only", "vowel_follows", "pair_likelihood", "dictionary_share", "separators", "other_signs", "known_prefix", "key_block", "path_test", "secret_word", "other_word", "assigned", "quoted", "known_form", "in_url", "login", "hook", "data_uri", "public", "sum", "pass_name", "spaces", "public_block"]


def _letter_pairs() -> np.ndarray:
    """Log-likelihood of each pair of letters, from the dictionary words."""
    n = np.full((26, 26), 0.2)
    for word in (*DICTIONARY, *OTHER_WORDS, *PATH_WORDS):
        for a, b in zip(word, word[1:], strict=False):
            if a.isalpha() and b.isalpha():
                n[ord(a) - 97, ord(b) - 97] += 1
    return np.log2(n / n.sum(1, keepdims=True))


_PAIRS = _letter_pairs()


def finding_features(token: str, before: str, after: str, path: str) -> list[float]:
    raw = token.encode("ascii", "replace")
    code = np.frombuffer(raw, np.uint8)
    kinds = _CLASS[code]
    n = len(raw)
    low = token.lower()
    counts = np.bincount(code)
    share = counts[counts > 0] / n
    covered = np.zeros(n, bool)
    for word in DICTIONARY:
        at = low.find(word)
        while at >= 0:
            covered[at : at + len(word)] = True
            at = low.find(word, at + 1)
    near = "".join(c if c.isalnum() or c == "_" else " " for c in before.lower()).split()
    tail = before.rstrip(" \"'`")
    lower = np.frombuffer(raw.lower(), np.uint8).astype(np.int64) - 97
    letters = (lower >= 0) & (lower < 26)
    pair = np.flatnonzero(letters[1:] & letters[:-1])
    vowel = np.isin(lower, (0, 4, 8, 14, 20))
    return [
        float(n),
        float((kinds[1:] != kinds[:-1]).mean()) if n > 1 else 0.0,
        float((kinds == 0).mean()),
        float((kinds == 1).mean()),
        float(((kinds == 1) | (kinds == 2)).mean()),
        float(-(share * np.log2(share)).sum()),
        float(all(c in "0123456789abcdef" for c in low)),
        float(token.isdigit()),
        float((~vowel[:-1] & vowel[1:]).sum()) / n,
        float(_PAIRS[lower[pair], lower[pair + 1]].mean()) if len(pair) else -9.0,
        float(covered.mean()),
        float((kinds == 3).sum()),
        float((kinds == 4).mean()),
        float(token.startswith(PREFIXES)),
        float(token.startswith("-----BEGIN ") and "PRIVATE KEY-----" in token[:60]),
        float(any(w in PATH_WORDS for w in "".join(c if c.isalnum() else " " for c in path.lower()).split())),
        float(any(s in w for w in near[-4:] for s in SECRET_WORDS)),
        float(any(w in OTHER_WORDS for w in near[-3:])),
        float(tail.endswith(("=", ":", ":="))),
        float(before.endswith(('"', "'", "`")) and after[:1] in ('"', "'", "`")),
        float(_FORMS.fullmatch(token) is not None),
        float(_IN_URL.search(before) is not None),
        float(after[:1] == "@" and before.endswith(":")),
        float("hook" in before.lower()[-60:] or "hook" in low),
        float(_DATA.search(before) is not None),
        float(_PUBLIC.search(before) is not None or token.startswith("AAAA")),
        float(_SUM.match(token) is not None),
        float(_PASS.search(before) is not None),
        float(token.count(" ")) / n,
        float(token.startswith("-----BEGIN ") and "PRIVATE KEY-----" not in token[:60]),
    ]


def labelled_findings(n: int = FINDINGS, seed: int = 5) -> list[tuple[str, str, str, str, int]]:
    """Generated findings (token, before, after, path, label): keys of many forms against digests, ids, names, paths and placeholders."""
    r = random.Random(seed)
    small = "abcdefghijklmnopqrstuvwxyz"
    big, digits, hexes = small.upper(), "0123456789", "0123456789abcdef"
    alnum, b64, signs = small + big + digits, small + big + digits + "+/", "!@#$%^&*?_-+"
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    syllable = lambda: pick("bcdfghlmnprstvw", r.randint(1, 2)) + pick("aeiou", r.randint(1, 2)) + r.choice(["", "", "n", "r", "s", "t", "ch", "ng"])
    word = lambda k=3: "".join(syllable() for _ in range(r.randint(1, k)))
    long_word = lambda: "".join(syllable() for _ in range(9))[: r.randint(16, 26)]
    prose = lambda k: " ".join(word() for _ in range(k))
    mixed = lambda k: "".join(r.sample(pick(small, k) + pick(big, 2) + pick(digits, 2) + pick(signs, r.randint(0, 2)), k)[:k])
    named = lambda: r.choice([*SECRET_WORDS, "client_secret", "DB_PASSWORD", "auth_token", "API_KEY", "AWS_SECRET_ACCESS_KEY", "apiKey", "TOKEN"])
    cased = lambda x: r.choice([x, x, x, x.upper()])
    # forms that tell by themselves, wherever they stand
    plain_keys = [
        lambda: r.choice(["AKIA", "ASIA"]) + pick(big + "234567", 16),
        lambda: r.choice(["ghp_", "gho_", "ghs_"]) + pick(alnum, 36),
        lambda: "github_pat_" + pick(alnum, 22) + "_" + pick(alnum, 59),
        lambda: r.choice(["xoxb-", "xoxp-"]) + "-".join([pick(digits, r.randint(2, 12)), pick(digits, r.randint(4, 12)), pick(alnum, 24)]),
        lambda: "sk-" + pick(alnum, r.choice([32, 40, 48])),
        lambda: r.choice(["sk_live_", "rk_live_"]) + pick(alnum, 24),
        lambda: "AIza" + pick(alnum + "_-", 35),
        lambda: r.choice(["glpat-", "npm_", "hf_"]) + pick(alnum, r.choice([20, 34, 36])),
        lambda: "eyJ" + pick(alnum + "_-", r.randint(17, 120)),
        lambda: pick(b64, r.randint(30, 64)),
        lambda: "-----BEGIN " + r.choice(["RSA ", "EC ", "OPENSSH ", ""]) + "PRIVATE KEY-----\n" + "\n".join(pick(b64, 64) for _ in range(r.randint(1, 20))) + "\n-----END PRIVATE KEY-----",
    ]
    # forms that are secrets where they are assigned to a secret's name
    assigned_keys = [
        lambda: cased(pick(hexes, r.choice([32, 40, 40, 40, 64]))),
        lambda: cased(pick(hexes, r.choice([32, 40, 40, 40, 64]))),
        lambda: pick(b64, r.randint(20, 60)),
        lambda: mixed(r.randint(8, 20)),
        lambda: pick(small, r.randint(24, 40)),
        lambda: pick(alnum, r.randint(10, 40)),
        lambda: word(2).title() + pick(digits, r.randint(2, 4)) + r.choice(signs) + pick(digits, 1),
    ]
    site = lambda: r.choice(["https://", "http://", "https://www."]) + word(2) + r.choice([".com", ".org", ".io", ".net"])
    padded = lambda k: pick(b64, k) + "=" * r.choice([0, 1, 2])
    # keys and passwords that stand in URLs, and passwords of several words: (token, before, after)
    placed_keys = [
        lambda: (r.choice([mixed(r.randint(8, 16)), word(2) + pick(digits, 3), pick(alnum, r.randint(6, 20))]), f"{prose(2)} {r.choice(['postgres', 'https', 'mysql', 'amqp', 'redis', 'ftp'])}://{word(2)}:", f"@{word(2)}.com/{word(1)}"),
        lambda: (r.choice(["com", "io"]) + "/services/T" + pick(big + digits, 8) + "/B" + pick(big + digits, 8) + "/" + pick(alnum, 24), f"{prose(2)} https://hooks.{word(2)}.", " "),
        lambda: ("/api/webhooks/" + pick(digits, 18) + "/" + pick(alnum + "_-", 68), f"{prose(2)} https://{word(2)}.com", " "),
        lambda: (pick(alnum, r.randint(20, 44)), f"{prose(2)} {site()}/{word(1)}?{r.choice(['access_token', 'token', 'api_key', 'apikey', 'auth', 'secret'])}=", r.choice([" ", "&", '"'])),
        lambda: (r.choice(["AKIA", "ASIA"]) + pick(big + "234567", 16), r.choice([f"{prose(1)} key ", f"{prose(2)} id ", f"the {r.choice(DICTIONARY)} {r.choice(DICTIONARY)} ", f"{prose(1)} {r.choice(OTHER_WORDS)} "]), r.choice([f" in {prose(1)}", " is ", ", ", ". "])),
        lambda: (" ".join(word(2) for _ in range(r.randint(3, 6))), f"{prose(1)} {r.choice(['passphrase', 'password', 'PASSPHRASE', 'pwd', 'db_password'])}{r.choice([' = ', ': ', '='])}" + '"', '"' + " "),
        lambda: (mixed(7)[:7], f"{prose(1)} {r.choice(['password', 'passwd', 'pwd', 'PASSWORD', 'db_pass' + 'word'])}{r.choice([' = ', ': ', '='])}{r.choice(['', chr(34)])}", r.choice([" ", "\n"])),
    ]
    others = [
        # encoded files, public halves, sums, names in URLs
        lambda: (padded(r.choice([24, 60, 200, 800, 2000])), f"{prose(1)} {r.choice(['src=', 'url(', '', 'href=', '![x]('])}{r.choice(['', chr(34)])}data:{r.choice(['image/png', 'image/gif', 'image/svg+xml', 'font/woff2', 'application/pdf'])};base64,", r.choice([" ", chr(34), ")"])),
        lambda: ("AAAAB3NzaC1yc2EAAAADAQABAAAB" + pick(b64, r.choice([60, 200, 340])), f"{prose(1)} ssh-rsa ", f" {word(2)}@{word(2)}"),
        lambda: ("AAAAC3NzaC1lZDI1NTE5AAAAI" + pick(b64, 43), f"{prose(1)} ssh-ed25519 ", f" {word(2)}"),
        lambda: ("-----BEGIN " + r.choice(["PUBLIC KEY", "CERTIFICATE", "RSA PUBLIC KEY", "PGP PUBLIC KEY BLOCK", "PGP SIGNATURE", "CERTIFICATE REQUEST"]) + "-----\n" + "\n".join(pick(b64, 64) for _ in range(r.randint(1, 20))) + "\n-----END CERTIFICATE-----", prose(2) + "\n", "\n"),
        lambda: (r.choice(["sha256-", "sha384-", "sha512-"]) + pick(b64, r.choice([43, 64, 86])), f"{prose(1)} integrity{r.choice(['=' + chr(34), ' ', ': ' + chr(34)])}", r.choice(["=", "==", chr(34)])),
        lambda: (pick(b64, r.choice([43, 86])), f"{prose(1)} {r.choice(['checksum', 'digest', 'public key', 'public_key', 'fingerprint SHA256'])}{r.choice([': ', ' = ', ':'])}", "="),
        lambda: (pick(alnum + "_-", r.choice([11, 20, 22, 28, 33, 33, 34, 44])), f"{prose(2)} {site()}/{r.choice(['file/d/', 'watch?v=', 'playlist?list=', 'open?id=', 'p/', 'share/', 'folders/', 'doc?id=', 's/', 'e/'])}", r.choice([" ", "/view", "&t=1", ")", chr(34)])),
        lambda: ("com/" + r.choice(["file/d/", "drive/folders/", "document/d/", "p/", "s/", "channel/"]) + pick(alnum + "_-", r.choice([22, 28, 33, 44])) + r.choice(["", "/view", "/edit"]), f"{prose(2)} https://{r.choice(['drive', 'docs', 'www', 'share'])}.{word(2)}.", r.choice([" ", "?usp=sharing", ")"])),
        lambda: ("com/" + "/".join(word(2) for _ in range(r.randint(2, 5))) + r.choice(["", "-" + pick(digits, 6), "/" + pick(hexes, 8)]), f"{prose(2)} https://www.{word(2)}.", r.choice([" ", ".html", "?x=1"])),
        lambda: (prose(r.randint(3, 8)), f"{prose(1)} {r.choice(['token', 'key', 'secret_name', 'auth', 'access', 'credential'])}{r.choice([': ', ' = '])}" + '"', '"' + " "),
        lambda: (pick(digits, r.choice([16, 16, 18, 20])), r.choice([prose(3) + " ", f"{prose(1)} {r.choice(OTHER_WORDS)} "]), " "),
        lambda: (cased(pick(hexes, r.choice([32, 40, 64]))), f"{prose(2)} {r.choice(OTHER_WORDS)} {r.choice(['', '= ', ': '])}", " "),
        lambda: (cased(pick(hexes, r.choice([32, 40, 64]))), prose(3) + " ", " "),
        lambda: ("-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12)), f"{prose(2)} {r.choice(['id', 'uuid', 'request id', 'guid'])}: ", " "),
        lambda: (cased(long_word()), prose(4) + " ", r.choice([" ", ", ", ". "])),
        lambda: (long_word().title(), prose(4) + r.choice([". ", " "]), " "),
        lambda: (r.choice("-_/").join(word() for _ in range(r.randint(4, 7))) + "xyz", prose(3) + r.choice([" ", " /", " ./"]), r.choice([" ", ".", ".py"])),
        lambda: ("".join(word(2).title() for _ in range(6)) + "Type", prose(2) + " ", "("),
        lambda: ("_".join(r.choice(DICTIONARY) for _ in range(4)), prose(2) + r.choice([" ", " = ", "."]), " "),
        lambda: ("/".join(r.choice(DICTIONARY) for _ in range(4)) + "/" + pick(digits, 4), prose(3) + r.choice([" ", " https://"]), " "),
        lambda: (r.choice("-_=+/") * r.randint(16, 60) + "a", prose(2) + "\n", "\n"),
        # assigned to a secret's name, and yet no secrets
        lambda: (r.choice(["your_", "my_", "example_", "test_", ""]) + r.choice(SECRET_WORDS) + r.choice(["_here", "_example", "_example_123", "_value", "_placeholder"]), f"{prose(1)} {named()} {r.choice('=:')} ", " "),
        lambda: (r.choice(["${", "{{", "<", "%("]) + named() + r.choice(["}", "}}", ">", ")s"]), f"{prose(1)} {named()} {r.choice('=:')} ", " "),
        lambda: (r.choice(["process.env.", "os.environ.", "config.", "self.", "settings."]) + named(), f"{prose(1)} {named()} = ", " "),
        lambda: (r.choice(["get", "read", "load", "fetch"]) + "".join(r.choice(DICTIONARY).title() for _ in range(2)) + "()", f"{named()} = ", ";"),
        lambda: (r.choice("x*.") * r.randint(8, 40), f"{prose(1)} {named()} {r.choice('=:')} ", " "),
        lambda: (r.choice(DICTIONARY) + r.choice(["_", "-", "."]) + r.choice(DICTIONARY), f"{prose(1)} {named()} {r.choice('=:')} ", " "),
        lambda: ("".join(syllable() for _ in range(6))[: r.randint(8, 14)] + r.choice(["", ",", "."]), f"{prose(2)} {named()}: ", " "),
    ]
    out = []
    for _ in range(n):
        quote = r.choice(['"', '"', "'", ""])
        path = r.choice(["src/app.py", "config/prod.yml", "deploy/env", "web/index.js", "notes.txt", "infra", "crawl", "books", ""])
        kind = r.random()
        if kind < 0.13:
            token, lead, follow = r.choice(placed_keys)()
            out.append((token, lead, follow, path, 1))
        elif kind < 0.28:
            lead, follow = r.choice([(prose(4) + " ", " " + prose(1)), (f"{prose(2)} = {quote}", f"{quote} "), (f"{named()}={quote}", f"{quote}\n")])
            out.append((r.choice(plain_keys)(), lead, follow, path, 1))
        elif kind < 0.52:
            out.append((r.choice(assigned_keys)(), f"{r.choice([prose(3), prose(1), ''])} {named()}{r.choice([' = ', ' = ', ': ', '='])}{quote}", f"{quote} {prose(2)}", path, 1))
        else:
            token, lead, follow = r.choice(others)()
            quote = r.choice([quote, ""])
            out.append((token, lead + quote, quote + follow, r.choice([path, path, "tests/fixtures/a.py", "docs/example.md"]), 0))
    return out


def train_forest(spark: SparkSession, findings: DataFrame | list[tuple[str, str, str, str, int]] | None = None, bound: int = FINDINGS) -> list[dict[str, np.ndarray]]:
    """A random forest as arrays, one dict for each tree: feature, threshold, left, right, value.

    findings: labelled ones (token, before, after, path, label 1 for a secret), of a table
    at most `bound` rows by a hash; generated ones where there are none.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.linalg import Vectors

    if isinstance(findings, DataFrame):
        sample = findings.select("token", *(F.coalesce(c, F.lit("")) for c in ("before", "after", "path")), "label").where("length(token) > 0 and label is not null")
        findings = [tuple(r) for r in sample.orderBy(F.xxhash64("token", "label")).limit(bound).collect()]
    rows = [(float(label), Vectors.dense(finding_features(t, b, a, p))) for t, b, a, p, label in findings or labelled_findings(bound)]
    data = spark.createDataFrame(rows, ["label", "features"]).repartition(4)
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=11, minInstancesPerNode=3).fit(data)
    out = []
    for tree in model._java_obj.trees():
        feature, threshold, left, right, value = [], [], [], [], []

        def walk(node) -> int:
            at = len(feature)
            stats = list(node.impurityStats().stats())
            feature.append(-1), threshold.append(0.0), left.append(at), right.append(at)
            value.append(stats[1] / max(sum(stats), 1e-9))
            if node.subtreeDepth():
                feature[at], threshold[at] = node.split().featureIndex(), node.split().threshold()
                left[at] = walk(node.leftChild())
                right[at] = walk(node.rightChild())
            return at

        walk(tree.rootNode())
        out.append({"feature": np.array(feature), "threshold": np.array(threshold), "left": np.array(left), "right": np.array(right), "value": np.array(value)})
    return out


def forest_scores(forest: list[dict[str, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """Mean over the trees of the share of secrets in the leaf."""
    total, rows = np.zeros(len(x)), np.arange(len(x))
    for t in forest:
        at = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            f = t["feature"][at]
            go_left = x[rows, np.maximum(f, 0)] <= t["threshold"][at]
            at = np.where(f < 0, at, np.where(go_left, t["left"][at], t["right"][at]))
        total += t["value"][at]
    return total / max(len(forest), 1)


def _candidates(data: np.ndarray, off: np.ndarray, raw: bytes) -> list[tuple[int, int, int]]:
    """(text number, start byte, end byte) of each candidate of a chunk, in order, none overlapping another."""
    w = T.Words(data, off, _TOKEN)
    alike = np.concatenate([[0], np.cumsum(_CLASS[data] < 3)])
    ok = (w.end - w.start >= MIN_RUN) & (alike[w.end] > alike[w.start])
    spans = list(zip(T.owner(w.first)[ok].tolist(), w.start[ok].tolist(), w.end[ok].tolist(), strict=True))
    signs = np.flatnonzero((data == 0x3D) | (data == 0x3A))
    for p, d in zip(signs.tolist(), (np.searchsorted(off, signs, "right") - 1).tolist(), strict=True):
        if _NAME.search(raw, max(int(off[d]), p - CONTEXT), p):
            words = _QUOTED.match(raw, p + 1, int(off[d + 1]))
            value = None if words else _VALUE.match(raw, p + 1, int(off[d + 1]))
            if words:
                spans.append((d, words.start(2), words.end(2)))
            elif value:
                end = value.end(1)
                while end - value.start(1) > MIN_VALUE and raw[end - 1] in b",;.)]}>" and raw[value.start(1)] not in b"<{$(%[":
                    end -= 1
                spans.append((d, value.start(1), end))
    for login in _LOGIN.finditer(raw):
        d = int(np.searchsorted(off, login.start(), "right")) - 1
        if login.end() <= off[d + 1]:
            spans.append((d, *login.span(1)))
    for begin in _BLOCK.finditer(raw):
        d = int(np.searchsorted(off, begin.start(), "right")) - 1
        end = _BLOCK_END.search(raw, begin.end(), int(off[d + 1]))
        if end and begin.end() <= off[d + 1]:
            spans.append((d, begin.start(), end.end()))
    out: list[tuple[int, int, int]] = []
    for d, a, z in sorted(spans):
        if out and out[-1][0] == d and a < out[-1][2]:
            out[-1] = (d, out[-1][1], max(z, out[-1][2]))
        else:
            out.append((d, a, z))
    return out


def scan_chunk(forest, text: pa.Array, path: pa.Array) -> tuple[bytes, np.ndarray, list[tuple[int, int, int, float]]]:
    """The chunk's bytes, where each text begins, and (text number, start byte, end byte, score) of each candidate in order."""
    data, off = T.utf8(text)
    raw = data.tobytes()
    spans = _candidates(data, off, raw)
    if not spans:
        return raw, off, []
    paths = path.cast(pa.string()).fill_null("").to_pylist()
    x = []
    for d, s, e in spans:
        before = raw[max(int(off[d]), s - CONTEXT) : s].decode("utf-8", "ignore")
        after = raw[e : min(int(off[d + 1]), e + 8)].decode("utf-8", "ignore")
        x.append(finding_features(raw[s:e].decode(), before, after, paths[d]))
    return raw, off, [(*span, float(p)) for span, p in zip(spans, forest_scores(forest, np.array(x)), strict=True)]


def _find(forest, least: float):
    def run(batches):
        for b in T.chunks(batches):
            ids = b.column("doc_id").to_pylist()
            raw, off, found = scan_chunk(forest, b.column("text"), b.column("path"))
            rows, seen = [], (-1, 0, 0)  # text, byte, character that have been counted up to
            for d, s, e, p in found:
                if seen[0] != d:
                    seen = (d, int(off[d]), 0)
                at = seen[2] + len(raw[seen[1] : s].decode())
                n = len(raw[s:e].decode())
                seen = (d, e, at + n)
                rows.append((ids[d], at, n, hashlib.sha256(raw[s:e]).hexdigest(), p, p >= least))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_()), strict=True)], names=["doc_id", "start", "n_chars", "value_sha256", "score", "is_secret"])

    return run


def find_secrets(docs: DataFrame, forest, path: str = "source", least: float = 0.5) -> DataFrame:
    """doc_id, start, n_chars, value_sha256, score, is_secret of every candidate."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", docs[path].alias("path")).mapInArrow(_find(forest, least), "doc_id long, start long, n_chars long, value_sha256 string, score double, is_secret boolean")


def _redact(forest, path: str, least: float, mark: str):
    def run(batches):
        for b in T.chunks(batches):
            texts = b.column("text")
            raw, off, found = scan_chunk(forest, texts, b.column(path))
            cuts: dict[int, list[tuple[int, int]]] = {}
            for d, s, e, p in found:
                if p >= least:
                    cuts.setdefault(d, []).append((s, e))
            if cuts:
                new = texts.to_pylist()
                for d, spans in cuts.items():
                    ends = [int(off[d]), *(e for _, e in spans)]
                    starts = [*(s for s, _ in spans), int(off[d + 1])]
                    new[d] = mark.join(raw[a:z].decode() for a, z in zip(ends, starts, strict=True))
                at = b.schema.get_field_index("text")
                b = b.set_column(at, b.schema.field(at), pa.array(new, texts.type))
                if "n_chars" in b.schema.names:
                    at = b.schema.get_field_index("n_chars")
                    kept = b.column("n_chars").to_pylist()
                    for d in cuts:
                        kept[d] = len(new[d])
                    b = b.set_column(at, b.schema.field(at), pa.array(kept, b.schema.field(at).type))
            yield b

    return run


def redact_secrets(docs: DataFrame, forest, path: str = "source", least: float = 0.5, mark: str = "<SECRET>") -> DataFrame:
    """All rows and columns of `docs`; secrets in text are replaced by `mark`, and n_chars follows."""
    return docs.mapInArrow(_redact(forest, path, least, mark), docs.schema)

"""Recall of the further spans, by kind, on secrets put into whole documents; none of these texts is made by ``pii.examples``."""

import random
from collections import Counter

from logloom.llm import pii

ALNUM, HEX = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef"
EACH = 60


def planted(r):
    """kind -> a function that makes (what stands before, the secret), and the same for harmless texts; ``unseen`` kinds have no counterpart among the examples."""
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    p = lambda a, k: "".join(r.choice(a) for _ in range(k))
    c = r.choice
    secret = {
        "password": lambda: (c(["password: ", "Password is: ", "passwd=", "pwd: ", "PASSWORD = "]), p(ALNUM + "!#%&*_-", r.randint(8, 16))),
        "access key id": lambda: (c(["", "aws key ", "AWS_ACCESS_KEY_ID="]), "AKIA" + p("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16)),
        "secret access key": lambda: (c(["AWS_SECRET_ACCESS_KEY=", "secret ", ""]), p(ALNUM + "+/", 40)),
        "repository token": lambda: (c(["token ", "", "GITHUB_TOKEN="]), c(["ghp_", "gho_", "ghs_"]) + p(ALNUM, 36)),
        "hex key": lambda: (c(["api-key: ", "apikey=", "X-Api-Key: ", ""]), p(HEX, c([32, 40, 64]))),
        "web token": lambda: (c(["Bearer ", "", "token: "]), f"eyJ{p(ALNUM, 30)}.eyJ{p(ALNUM, 40)}.{p(ALNUM + '-_', 43)}"),
        "iban": lambda: (c(["IBAN ", "iban: ", ""]), c(["DE", "FR", "NL", "GB"]) + d(20)),
        "iban in groups": lambda: ("IBAN ", f"{c(['DE', 'FR'])}{d(2)} {' '.join(d(4) for _ in range(4))} {d(2)}"),
        "social security": lambda: (c(["ssn ", "SSN: ", "social security ", ""]), f"{d(3)}-{d(2)}-{d(4)}"),
        "national phone": lambda: (c(["call ", "tel: ", "at ", "phone "]), c([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}"])),
        "birth date": lambda: (c(["dob ", "born ", "date of birth: "]), c([f"{d(2)}/{d(2)}/19{d(2)}", f"19{d(2)}-{d(2)}-{d(2)}", f"{d(2)}.{d(2)}.19{d(2)}"])),
        "hardware address": lambda: (c(["", "mac ", "device "]), ":".join(p(HEX, 2) for _ in range(6))),
        "passport": lambda: ("passport " + c(["", "no ", "number "]), p("ABCDEFGHX", 1) + d(8)),
        "account": lambda: (c(["account ", "account no ", "acct "]), d(r.randint(9, 12))),
        "chat token": lambda: (c(["", "token="]), f"xox{c('bp')}-{d(12)}-{p(ALNUM, 24)}"),
        "ipv6": lambda: (c(["from ", "host ", ""]), ":".join(p(HEX, 4) for _ in range(8))),
        "password in an address": lambda: ("", f"postgres://{p('abcdefgh', 6)}:{p(ALNUM, 12)}@db{d(1)}.internal/x"),
    }
    unseen = {
        "public key": lambda: ("ssh-rsa ", "AAAAB3NzaC1yc2E" + p(ALNUM + "+/", 200)), "json secret": lambda: ('"client_secret": ', f'"{p(ALNUM + "~-_", 34)}"'), "cookie": lambda: ("Cookie: ", f"sessionid={p(HEX, 32)}"),
        "basic auth": lambda: ("Authorization: Basic ", p(ALNUM, 22) + "=="), "uuid key": lambda: ("apikey ", "-".join(p(HEX, k) for k in (8, 4, 4, 4, 12))), "hook": lambda: ("", f"https://hooks.example.com/services/T{p(ALNUM, 8)}/B{p(ALNUM, 8)}/{p(ALNUM, 24)}"),
    }
    harmless = {
        "years": lambda: ("in ", f"19{d(2)}-19{d(2)}"), "page": lambda: ("page ", f"{d(2)} of {d(3)}"), "version": lambda: ("version ", f"{d(1)}.{d(2)}.{d(1)}"), "isbn": lambda: ("ISBN ", f"978-{d(1)}-{d(3)}-{d(5)}-{d(1)}"),
        "time": lambda: ("at ", f"{d(2)}:{d(2)}:{d(2)}"), "fraction": lambda: ("about ", f"3.{d(5)}"), "formula": lambda: ("", f"x = {d(1)}"), "price": lambda: ("costs ", f"${d(1)},{d(3)}.{d(2)}"), "share": lambda: ("", f"{d(2)}.{d(1)}%"),
        "section": lambda: ("section ", f"{d(1)}.{d(1)}.{d(1)}"), "ordinal": lambda: ("the ", f"{d(2)}th century"), "date": lambda: ("on ", f"20{d(2)}-0{r.randint(1, 9)}-1{d(1)}"), "people": lambda: ("of ", f"{d(1)},{d(3)},{d(3)} people"),
        "address": lambda: ("see ", f"https://example.org/a{d(4)}/page"), "compound": lambda: ("", f"C{d(1)}H{d(2)}O{d(1)}"), "score": lambda: ("won ", f"{d(2)}-{d(2)}"), "engine": lambda: ("the ", f"A{d(3)}-{d(3)} engine"), "mention": lambda: ("", f"@{p('abcdefgh', 8)} said"),
        "pixels": lambda: ("", f"{d(4)}x{d(4)} pixels"), "lines": lambda: ("lines ", f"{d(4)}-{d(4)}"),
    }
    return secret, unseen, harmless


def test_recall_by_kind(spark, tiny):
    r = random.Random(99)
    base = [x.text for x in spark.read.parquet(f"{tiny}/documents.parquet").where("text not rlike '[0-9@=]' and length(text) > 100").collect()]
    rows, about = [], []
    for label, kinds in enumerate(planted(r)):
        for kind, make in kinds.items():
            for _ in range(EACH):
                before, text = make()
                x = r.choice(base)
                cut = r.randrange(20, len(x) - 20)
                lead = f"{x[:cut]} {before}"
                rows.append((len(rows), f"{lead}{text}{r.choice([' ', chr(10), '. ', ', '])}{x[cut:]}"))
                about.append((label, kind, len(lead), len(lead) + len(text)))
    got = {x.doc_id: [s.split(":") for s in x.spans.split(",") if s] for x in pii.find_pii(spark.createDataFrame(rows, "doc_id int, text string")).select("doc_id", "spans").collect()}
    hit = Counter()
    for k, (label, kind, a, b) in enumerate(about):
        hit[label, kind] += any(int(s) < b and int(e) > a for _, s, e in got[k])
    share = {x: hit[x] / EACH for x in {(label, kind) for label, kind, _, _ in about}}
    mean = [sum(v for (label, _), v in share.items() if label == k) / sum(label == k for label, _ in share) for k in range(3)]
    print("recall", mean[0], "of unseen kinds", mean[1], "harmless taken", mean[2], {k: v for k, v in sorted(share.items()) if (v < 1 if k[0] < 2 else v > 0)})
    assert mean[0] >= 0.95 and min(v for (label, _), v in share.items() if label == 0) >= 0.9
    assert mean[1] >= 0.9 and mean[2] <= 0.05

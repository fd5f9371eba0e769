"""Kinds of documents by the words of academic papers and by the names of files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossierlake.functions.text import once

# Words that are often misread, with what they stand for.
REPAIRS = (
    (r"\bH[1I]GHER\b", "HIGHER"),
    (r"\bSEC[O0]NDARY\b", "SECONDARY"),
    (r"\bCERT[1I]F[1I]CATE\b", "CERTIFICATE"),
    (r"\bEXAM[1I]NAT[1I][O0]N\b", "EXAMINATION"),
    (r"\bUNIVERS[1I]TY\b", "UNIVERSITY"),
    (r"\bCERTIF[1I]ED\b", "CERTIFIED"),
    (r"\bM[AÀ]HARASHTRA\b", "MAHARASHTRA"),
    (r"\bB[O0]ARD\b", "BOARD"),
    (r"\bSCH[O0][O0]L\b", "SCHOOL"),
    (r"\bS+T+A+T+E+M+E+N+T\b", "STATEMENT"),
    (r"\bMARKS?\b", "MARKS"),
    (r"\bR[E3]SULT\b", "RESULT"),
    (r"\bPASS(?:ED)?\b", "PASS"),
    (r"\bFAIL(?:ED)?\b", "FAIL"),
    (r"\bD[1I]ST[1I]NCT[1I][O0]N\b", "DISTINCTION"),
)
# Signs of a marksheet, of a certificate, and of each level.
MARKSHEET = (
    r"statement\s+of\s+(marks?|grades?)", r"marks?\s+obtained", r"subject\s+code", r"total\s+marks?", r"grand\s+total", r"percentage\s+of\s+marks?", r"\bcgpa\b", r"\bsgpa\b",
    r"\bgrade\s+point\b", r"marks?\s+sheet", r"marksheet", r"exam(?:ination)?\s+result", r"semester\s+(?:grade|result|performance)", r"consolidated\s+(?:marks?|statement)",
    r"academic\s+transcript", r"grade\s+card", r"seat\s+no", r"seat\s+number", r"roll\s+no", r"examinee", r"march\s*[–\-]\s*20[0-9][0-9]", r"oct(?:ober)?\s*[–\-]\s*20[0-9][0-9]",
    r"total\s+percentage", r"percentage\s+marks?", r"गुण\s*पत्रक", r"परिणाम\s*पत्रक",
)
CERTIFICATE = (
    r"this\s+is\s+to\s+certify\s+that", r"certified\s+that", r"has\s+passed\s+the", r"certificate\s+examination", r"awarded\s+(?:the\s+)?degree", r"awarded\s+to", r"conferred\s+(?:the\s+)?degree",
    r"degree\s+of\s+(?:bachelor|master|doctor)", r"\bdivision\b", r"\bfirst\s+class\b", r"\bdistinction\b", r"convocation", r"passed\s+with\s+(?:distinction|first|second)",
    r"certificate\s+of\s+(?:passing|completion)", r"migration\s+certificate", r"passing\s+certificate",
)
LEVELS = {
    "ssc": (
        r"secondary\s+school\s+certificate", r"माध्यमिक\s+शालान्त", r"\bssc\b", r"class\s*(?:x\b|10\b|10th\b)", r"(?:std|standard)[\.\s]+(?:x|10)", r"10\s*(?:th)?\s+(?:standard|class|board)",
        r"secondary\s+education", r"high\s+school\s+(?:certificate|exam)", r"matric(?:ulation)?", r"माध्यमिक", r"इयत्ता\s*१०", r"class\s+x\b", r"std\s*x\b", r"grade\s+10\b",
    ),
    "hsc": (
        r"higher\s+secondary\s+certificate", r"उच्च\s*माध्यमिक", r"\bhsc\b", r"class\s*(?:xii\b|12\b|12th\b)", r"(?:std|standard)[\.\s]+(?:xii|12)", r"12\s*(?:th)?\s+(?:standard|class|board)",
        r"(?:science|commerce|arts)\s+stream", r"(?:junior|senior)\s+college", r"intermediate\s+(?:examination|board)", r"pre[\s\-]university", r"higher\s+secondary", r"h\.s\.c", r"std\s*xii\b", r"std\s*12\b",
        r"march.*examination", r"examination.*march", r"मुंबई\s+विभाग", r"पुणे\s+विभाग", r"नागपूर\s+विभाग", r"उच्च\s+माध्यमिक", r"इयत्ता\s*१२", r"विज्ञान\s+शाखा", r"वाणिज्य\s+शाखा", r"कला\s+शाखा",
        r"h[1i]gher\s+sec", r"higher\s+sec[o0]ndary", r"h\.?s\.?c\.?\s+exam",
    ),
    "degree": (
        r"\bbachelor\b", r"\bmaster\b", r"\bb[\.\s]?(?:e|tech|sc|com|ca|cs|a|ed)\b", r"\bm[\.\s]?(?:e|tech|sc|com|ba|ca|cs|ed|b|a)\b", r"\bphd\b|\bdoctor(?:ate)?\b", r"\bprn\b", r"semester\s+[ivxlc0-9]+",
        r"(?:affiliated|autonomous)\s+(?:college|university)", r"university\s+(?:of|examination)", r"\bdiploma\b", r"\bpgd\b|\bpgdm\b",
    ),
}
# Boards and universities by how texts name them, in the order in which they are tried.
BOARDS = (
    (r"maharashtra\s+state\s+board", "Maharashtra State Board"),
    (r"msbshse", "Maharashtra State Board"),
    (r"state\s+board.*maharashtra", "Maharashtra State Board"),
    (r"maharashtra.*board", "Maharashtra State Board"),
    (r"cbse|central\s+board\s+of\s+secondary", "CBSE"),
    (r"cisce|icse|isc\b", "CISCE/ICSE"),
    (r"state\s+board\s+of\s+(?:gujarat|rajasthan|karnataka|tamilnadu|tamil\s+nadu|kerala|andhra|telangana|west\s+bengal|uttar\s+pradesh)", "State Board"),
    (r"shivaji\s+university", "Shivaji University, Kolhapur"),
    (r"savitribai\s+phule\s+(?:pune\s+)?university", "Savitribai Phule Pune University"),
    (r"university\s+of\s+(?:mumbai|bombay)", "University of Mumbai"),
    (r"nagpur\s+university|rtmnu", "Rashtrasant Tukadoji Maharaj Nagpur University"),
    (r"dr[\.\s]+babasaheb\s+ambedkar", "Dr. Babasaheb Ambedkar Marathwada University"),
    (r"swami\s+ramanand", "Swami Ramanand Teerth Marathwada University"),
    (r"north\s+maharashtra\s+university", "North Maharashtra University"),
    (r"solapur\s+university", "Solapur University"),
    (r"iit[\s\-]?(?:bombay|delhi|madras|kanpur|kharagpur|roorkee|guwahati|hyderabad)", "IIT"),
    (r"nit[\s\-]?\w+", "NIT"),
    (r"anna\s+university", "Anna University"),
    (r"osmania\s+university", "Osmania University"),
    (r"bangalore\s+university|bengaluru\s+university", "Bangalore University"),
    (r"calcutta\s+university|university\s+of\s+calcutta", "University of Calcutta"),
    (r"delhi\s+university|university\s+of\s+delhi", "University of Delhi"),
    (r"amity\s+university", "Amity University"),
    (r"punjab\s+university", "Panjab University"),
    (r"rajasthan\s+university", "University of Rajasthan"),
    (r"gujarat\s+university", "Gujarat University"),
    (r"kerala\s+university", "University of Kerala"),
)
HINTS = {"ssc": ("ssc",), "hsc": ("hsc",), "degree": ("degree", "university", "pg", "ug")}
# What the name of a file says of its class and of its type, in the order in which it is looked for; seconds that a class is given, and whether its images are left out.
CLASSES = (
    ("kyc", ("aadhaar", "aadhar", "uid", "pan", "passport", "dl", "driving", "voter", "license", "licence")),
    ("academic", ("marksheet", "markcard", "transcript", "degree", "certificate", "diploma", "result", "grades", "ssc", "hsc", "tenth", "twelfth", "semester", "resume", "cv")),
    ("bank", ("bank", "statement", "account", "passbook")),
    ("invoice", ("invoice", "bill", "receipt")),
)
TYPES = (
    ("aadhaar", ("aadhaar", "aadhar", "uid")), ("pan", ("pan",)), ("passport", ("passport",)), ("driving_license", ("driving", "dl")), ("voter_id", ("voter",)), ("bank_statement", ("bank", "statement")), ("invoice", ("invoice",)),
    ("marksheet", ("marksheet",)), ("transcript", ("transcript",)), ("degree_certificate", ("degree",)), ("diploma", ("diploma",)), ("resume", ("resume", "cv")),
)
SECONDS = {"kyc": 45, "academic": 90, "bank": 300, "invoice": 120, "unknown": 120}


def unmixed(text: Column) -> Column:
    """A text without signs of other scripts, blanks once, and its misread words mended."""
    out = F.regexp_replace(F.regexp_replace(text, r"[^\x20-\x7E\x{0900}-\x{097F}\n]", " "), r"[ \t]+", " ")
    for pattern, word in REPAIRS:
        out = F.regexp_replace(out, "(?i)" + pattern, word)
    return out


def _count(low: Column, patterns: tuple[str, ...]) -> Column:
    return sum((F.when(low.rlike("(?U)" + p), 1).otherwise(0) for p in patterns[1:]), F.when(low.rlike("(?U)" + patterns[0]), 1).otherwise(0))


def board(low: Column) -> Column:
    """The board or university that a lower-cased text names, by the first pattern that occurs."""
    return F.coalesce(*[F.when(low.rlike("(?U)" + p), name) for p, name in BOARDS])


def paper_kind(text: Column, hint: Column | None = None) -> Column:
    """A struct of category, level, subtype, board, level_confidence and subtype_confidence of an academic paper.

    Levels and subtypes go by how many of their signs occur; a hint adds 20 to its level. A text of less than ten
    characters or without any sign, a null one too, is taken for the marksheet of a higher school, with little confidence.
    """
    fixed = F.struct(F.lit("hsc_marksheet").alias("category"), F.lit("hsc").alias("level"), F.lit("marksheet").alias("subtype"), F.lit(None).cast("string").alias("board"), F.lit(0.25).alias("level_confidence"), F.lit(0.5).alias("subtype_confidence"))

    def count(low: Column) -> Column:
        levels = []
        for level, patterns in LEVELS.items():
            own = _count(low, patterns)
            levels.append((own if hint is None else own + F.when(F.coalesce(hint.isin(*HINTS[level]), F.lit(False)), 20).otherwise(0)).alias(level))
        return F.struct(_count(low, MARKSHEET).alias("sheet"), _count(low, CERTIFICATE).alias("paper"), *levels, low.rlike(r"(?U)\bmarks?\b|\btotal\b|\bsubject\b").alias("marked"), board(low).alias("board"))

    def judge(c: Column) -> Column:
        subtype = F.when(c["sheet"] > c["paper"], "marksheet").when(c["paper"] > c["sheet"], "certificate").when(c["marked"], "marksheet").otherwise("certificate")
        surer = F.when(c["sheet"] == c["paper"], 0.5).otherwise(F.greatest(c["sheet"], c["paper"]) / F.greatest(c["sheet"] + c["paper"], F.lit(1)))
        level = F.when(c["degree"] > F.greatest(c["ssc"], c["hsc"]), "degree").when(c["hsc"] > c["ssc"], "hsc").when(c["ssc"] > 0, "ssc").when(c["board"].isNotNull(), "hsc")
        total = F.greatest(c["ssc"] + c["hsc"] + c["degree"], F.lit(1))
        sure = F.when(level == "degree", c["degree"] / total).when((level == "hsc") & (c["hsc"] > c["ssc"]), c["hsc"] / total).when(level == "ssc", c["ssc"] / total).otherwise(0.35)
        found = F.struct(F.concat_ws("_", level, subtype).alias("category"), level.alias("level"), subtype.alias("subtype"), c["board"].alias("board"), F.round(sure, 3).alias("level_confidence"), F.round(surer, 3).alias("subtype_confidence"))
        return F.when(level.isNotNull(), found).otherwise(fixed)

    short = F.coalesce(F.length(F.regexp_replace(text, r"^\s+|\s+$", "")) < 10, F.lit(True))
    return F.when(short, fixed).otherwise(once(once(F.lower(unmixed(text)), count), judge))


def routed(filename: Column, head: Column) -> Column:
    """A struct of doc_class, doc_type, is_pdf, seconds and skip_images of a file, by its name without its ending and its first bytes."""
    low = F.lower(F.coalesce(filename, F.lit("")))
    base = F.when(low.rlike(r"[^./][^/]*\.[^./]*$"), F.regexp_extract(low, r"^(.*[^./][^/]*)\.[^./]*$", 1)).otherwise(low)
    pdf = F.coalesce(F.hex(F.substring(head, 1, 4)) == "25504446", F.lit(False))
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(base, w))
    kind = F.coalesce(*[F.when(has(words), name) for name, words in CLASSES], F.when(pdf, "academic"), F.lit("unknown"))
    seconds = F.create_map(*[F.lit(x) for pair in SECONDS.items() for x in pair])
    return F.struct(kind.alias("doc_class"), F.coalesce(*[F.when(has(words), name) for name, words in TYPES], F.lit("unknown")).alias("doc_type"), pdf.alias("is_pdf"), F.element_at(seconds, kind).alias("seconds"), (kind == "bank").alias("skip_images"))

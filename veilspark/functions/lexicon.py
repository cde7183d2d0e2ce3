"""What detection has to compare with."""

from __future__ import annotations

# Fourth letters of a tax number (the holder's kind).
PAN_HOLDERS = "PCHFATBLJG"

# Top-level domains of e-mail addresses.
TLDS = (
    "com net org edu gov mil int info biz name pro mobi email cloud online site store tech app dev io ai me co xyz bank "
    "in us uk au ca de fr jp cn ru br it nl es se ch sg hk ae nz za"
).split()

# Handles of payment providers.
UPI_HANDLES = (
    "ybl paytm sbi okicici okhdfcbank okaxis axl apl ibibo freecharge phonepe upi cred mobikwik pnb yesbank icici hdfcbank "
    "idfc kotak indus unionbankofindia canarabank boi barodaupi rbl federal"
).split()

# Bank codes that branch codes begin with (each once; some can match no code of four capitals).
BANK_CODES = (
    "SBIN UBIN CNRB SBHY SBTR SBTM SBPO PUNB BARB BARD IDIB IOBA UCBA ANDH CBIN CDRB Corpy KVGB KARB MAHB ORBC PSIB PYSB "
    "RATN SKSB TMBL TJSB UBI UCO UNBA VIJB HDFC ICIC UTIB AXIS KKBK CITI CHAS DLXB FDRL IDFB INDB JAKA KBL KVB LAVB MCBL "
    "NKGS PMCB SIBL TNSL UJVN VYSA ABNA ANDB BBKM BNPA BPVI BRIT CRES DEUT DOSM HSBC ICBC INGV JPMC KBEK KRESC MHBK MIDL "
    "MOSM NOWB OCBC PNBC PTCB RZVL SCBL SCOE SMBC SOGE SONA STBK TBTM UBSW WFCB WFBI AIRT AIRP JIOS PAYU YESB YTLC AUBL "
    "BAFL BDBL BJSA Capital CCBL ESAF GSCB HABU ICBL JAIB JALX KESR KLGX KMBL KNSB KVCB LDCB LVRD MCLX NAIN NESF PNBK POSB "
    "PUCL RAJA RBLX S3BK SAHE SATJ SBLD STCB SURY TBLX TNPC UCBL UOVB VAVB VCBL VKBL"
).split()

# Tokens that are never names.
NOT_NAMES = (
    "work mail email info contact admin office hello team help support noreply reply test user official career careers jobs "
    "sales bank statement account india limited private resume curriculum vitae profile summary"
).split()

# Words around a number that speak for its type (first list) or against it (second list), in order.
CONTEXT_TERMS = {
    "AADHAAR": (
        ("aadhaar", "aadhar", "uid", "uidai"),
        ("utr", "rrn", "ref", "reference", "txn", "transaction", "imps", "neft", "rtgs", "cheque", "invoice", "order"),
    ),
    "PHONE": (
        ("phone", "mobile", "mob", "contact", "tel", "whatsapp", "helpline"),
        ("utr", "rrn", "ref", "reference", "txn", "transaction", "imps", "neft", "rtgs", "cheque", "challan", "invoice", "order", "a/c", "account", "urn", "folio"),
    ),
    "ACCOUNT": (
        ("a/c", "account", "acct", "cif", "customer id", "ckycr"),
        ("utr", "rrn", "ref", "reference", "txn", "transaction", "imps", "neft", "rtgs", "cheque", "invoice", "order", "bill"),
    ),
}

# Patterns of the detectors.
PAN = r"[A-Z]{5}[0-9]{4}[A-Z]"
AADHAAR_GROUPS = r"(?<![0-9])[0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{4}(?![0-9])"
AADHAAR_PLAIN = r"(?<![0-9])[0-9]{12}(?![0-9])"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = (r"\+[0-9]{1,3}[-.\s]?[0-9]{4,14}", r"\b0[0-9]{10}\b", r"[0-9]{3}[-.\s][0-9]{3}[-.\s][0-9]{4}", r"[0-9]{4}[-.\s][0-9]{3}[-.\s][0-9]{3}", r"[0-9]{5}[-.\s][0-9]{5}", r"\b[0-9]{10}\b")
UPI = r"[a-zA-Z0-9._-]+@[a-zA-Z][a-zA-Z0-9._-]*"
IFSC = r"[A-Z]{4}0[A-Z0-9]{6}"
ACCOUNT_LABEL = r"(?i:(?:Account|Acct|A/C|Acc|A/?c)\s*(?:No\.?|Number|#)?\s*[:.]?\s*)"
ACCOUNT_ALONE = r"\b[0-9]{11,15}\b"
LEDGER = r"(?i)^\s*AT\s*[0-9]{5}\b"
LABEL_AT_END = r"(?i)(?:Account|A/?c|CIF|CKYCR|Customer\s*ID)(?:\s*(?:No\.?|Number|ID|#))?\s*[:.]?\s*$"
PROFILE = r"(?:linkedin\.com/in/|github\.com/)([A-Za-z0-9_-]{3,})"
EMAIL_LOCAL = r"([a-zA-Z0-9._%+-]+)@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"

# Detector tiers in fusion.
TIERS = {"regex": 5, "validator": 4, "heuristic": 3, "ner": 2, "llm": 1}
TIER_OF = {"pan": "regex", "aadhaar": "regex", "email": "regex", "phone": "regex", "upi": "regex"}

# Statement profiles (aliases, code prefixes, account patterns, in order of registration).
BANKS = {
    "sbi": (("state bank of india", "sbi", "sbi bank", "state bank"), ("SBIN",), (r"\b[0-9]{11}\b", r"\b[0-9]{15}\b")),
    "hdfc": (("hdfc bank", "hdfc", "hdfc bank ltd", "hdfc ltd"), ("HDFC",), (r"\b[0-9]{14}\b",)),
    "icici": (("icici bank", "icici", "icici bank ltd", "icici ltd"), ("ICIC",), (r"\b[0-9]{12}\b", r"\b[0-9]{15}\b")),
    "axis": (("axis bank", "axis", "axis bank ltd"), ("UTIB", "AXIS"), (r"\b[0-9]{15}\b",)),
}
BANK_IFSC = r"\b[A-Z]{4}0[A-Z0-9]{6}\b"
PERIODS = (
    r"(?i)(?:statement\s+)?period\s*[:\-]?\s*([0-9]{1,2}\s+[A-Z][a-z]+\s+[0-9]{4})\s*(?:to|-|–)\s*([0-9]{1,2}\s+[A-Z][a-z]+\s+[0-9]{4})",
    r"(?i)(?:statement\s+)?period\s*[:\-]?\s*([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})\s*(?:to|-|–)\s*([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})",
    r"(?i)from\s+([0-9]{1,2}\s+[A-Z][a-z]+\s+[0-9]{4})\s*(?:to|-|–)\s*([0-9]{1,2}\s+[A-Z][a-z]+\s+[0-9]{4})",
)
HOLDERS = (
    r"\b[Aa]ccount\s+[Hh]older\s*:\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)",
    r"\b[Nn]ame\s*:\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)",
    r"\b[Cc]ustomer\s+[Nn]ame\s*:\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)",
)

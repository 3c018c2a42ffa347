"""Values that results depend on. They are fixed: do not edit, reorder or extend them."""

# Default search patterns, one per line. Order decides keyword order in the logs.
DEFAULT_SEARCH_PATTERNS = r"""
\bdovolen[aeouyi][a-z]*
\bdov\b
\bdov\.
\bcerp[aei][a-z]*\s+dovolen
\bzaslouzen[aeouyi]*\s+dovolen
\bradn[aeouyi]*\s+dovolen
\bprazdnin[aeouyi]*
\bprazd\.
\bvoln[aeouyi][a-z]*
\bvoln\b
\bnepritom[a-z]*
\bneprit\b
\bneprit\.
\bmimo\s+kancela[rz][a-z]*
\bmimo\s+k\b
\bmimo\s+k\.
\bmimo\s+provoz
\bo+\s*o+\s*o+
\bout\s+of\s+office
\bout\s+off
\bnemocensk[aeouyi]*
\bnemoc\b
\bnemoc\.
\bnem\b
\bnem\.
\bpn\b
\bp\.?\s*n\.
\bpracovn[aeouyi]*\s+neschopn
\bneschopenk[aeouyi]
\bzdravotn[aeouyi][a-z]*
\bzdr\.
\bzdr\s+voln
\bzdr\s+d[uu]vod
\babsen[ct][a-z]*
\babs\b
\babs\.
\bnedostupn[aeouyi]*
\bnedost\b
\bnedost\.
\bne\s+budu\s+dostupn
\brodicovsk[aeouyi]*
\brd\b
\brd\.
\br\.?\s*d\.
\bmatersk[aeouyi]*
\bmat\b
\bmat\.
\botcovsk[aeouyi]*
\bot\b
\bot\.
\bvrat[ii][a-z]*\s+se
\bzpet\s+(od|az|do|v)
\bnavrat
\bbudu\s+zpet
\bbudu\s+zpatky
\bzpat(ky|ecky)
\bk\s+dispozici
\bdispozic[iei]
\bne\s+budu\s+k\s+zastiz
\bk\s+zastiz
\buziv[aei][a-z]*
\bbav[ii][a-z]*\s+se
\brelax
\bodpociv[aei]
\bvacation
\bholiday
\bholidays
\bsick\s+leave
\bsick\s+day
\bsickday
\btime\s+off
\bpto\b
\bleave\b
\bunavailable
\baway
\boff\s+work
\boff\s+duty
\bautoreply
\bauto\s+reply
\bautomatic\s+reply
\bv\s+dob[ee]\s+m[ee]\s+nepritom
\bpo\s+dobu\s+m[ee]\s+nepritom
\bbehem\s+m[ee]\s+nepritom
\bodpov[ii][a-z]*\s+az\s+po
\bnemonitor
\bne\s+check
\bomezen[aeouyi]*\s+prist
\blimited\s+access
\bno\s+access
\bno\s+email
\bod\s+\d+\.\d+
\bdo\s+\d+\.\d+
\baz\s+do\s+\d+
\bvr[aa]t[ii][a-z]*\s+\d+\.
""".split("\n")[1:-1]

# Lines that open quoted history.
QUOTE_LINE_PATTERNS = r"""
^On\s+.+\d{4}.+wrote:\s*$
^On\s+\d{1,2}/\d{1,2}/\d{2,4}.+wrote:\s*$
^Dne\s+\d{1,2}\.\d{1,2}\.\d{2,4}.+napsal
^Dne\s+.+napsal\(a\):
^-{3,}.*Original.*Message.*-{3,}
^_{5,}\s*$
^From:\s*.+$
^\s*>+
^\s*\|
^\d{4}-\d{2}-\d{2}\s+\d{1,2}:\d{2}.+wrote:
^\[\d{4}-\d{2}-\d{2}
""".split("\n")[1:-1]

# Letters folded to ASCII, and what each becomes.
CZECH_LETTERS = "áčďéěíňóřšťúůýž"
CZECH_ASCII = "acdeeinorstuuyz"
EUROPEAN_LETTERS = "áàâäãåčçćďéèêëěíìîïňñóòôöõøřšśťúùûüůýÿžźż"
EUROPEAN_ASCII = "aaaaaacccdeeeeeiiiinnoooooorsstuuuuuyyzzz"

# Whitespace as the mail rules understand it (what str.strip() removes).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# File-name rules.
FORBIDDEN_IN_NAMES = '<>:"/\\|?*'
NAME_PART_LENGTH = 30
MESSAGE_ID_LENGTH = 20
FILE_NAME_LENGTH = 255

# Length thresholds of the search and reply rules.
MIN_BODY_LENGTH = 10
MIN_REPLY_LENGTH = 20

# Classifier input and log truncations, default prices in USD per million tokens.
PROMPT_BODY_LENGTH = 4000
LOG_REASONING_LENGTH = 200
LOG_HEADER_LENGTH = 100
PRICE_INPUT = 0.15
PRICE_OUTPUT = 0.60

# Charsets tried in turn after the declared one.
CHARSET_ORDER = ("cp1250", "utf-8", "latin1")

# Log columns, in file order.
EXTRACTION_LOG = [
    "filename", "original_filename", "collision", "date", "from_address", "to", "subject",
    "matched_keywords", "match_positions",
]
ATTACHMENT_LOG = [
    "uuid", "eml_filename", "date", "from_address", "subject", "message_id", "attachment_count",
    "attachment_names", "attachment_sizes", "attachment_types", "total_size_bytes",
    "processing_time_ms",
]
CLASSIFICATION_LOG = [
    "filename", "processed_at", "llm_decision", "confidence", "reasoning", "prompt_tokens",
    "completion_tokens", "total_tokens", "processing_time_ms", "error_message", "retried",
    "from_address", "subject", "output_filename",
]

# The frame around criteria and message in the scorer's input.
PROMPT_FORMAT = (
    "%s\n\nEMAIL TO ANALYZE:\nFrom: %s\nDate: %s\nSubject: %s\n\n%s\n\n"
    "Respond with JSON only:\n"
    '{"is_match": true/false, "confidence": 0.95, "reasoning": "brief explanation"}'
)

# Lower bounds of the confidence bands used in review and in the prompts.
REVIEW_BANDS = (0.90, 0.70, 0.50)
PROMPT_BANDS = (0.95, 0.80, 0.60, 0.40)

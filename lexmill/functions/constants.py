"""Word lists, lookup tables, patterns and thresholds that results depend on.

Patterns are written so that Java and RE2 read them the same way: Unicode white
space is spelled out as ``[WS_CLASS]`` and a digit as ``\\p{Nd}``.
"""

# --- white space (the characters that a Unicode strip removes) ---------------------------
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WS_CLASS = (
    r"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
S = f"[{WS_CLASS}]"
D = r"\p{Nd}"

# Characters that NFKC leaves alone in any order: texts made of them skip normalisation.
NFKC_STABLE_CLASS = (
    r"\x{00}-\x{7f}\x{a1}-\x{a7}\x{a9}\x{ab}-\x{ae}\x{b0}\x{b1}\x{b6}\x{b7}\x{bb}\x{bf}-\x{ff}"
    r"\x{2010}\x{2013}-\x{2016}\x{2018}-\x{201f}\x{2020}-\x{2023}\x{25a0}-\x{25ff}"
    r"\x{3001}-\x{3003}\x{3008}-\x{3011}\x{4e00}-\x{9fff}\x{ac00}-\x{d7a3}"
)
# Runs of the frequent ones first: a class of many ranges is slow to test.
NFKC_STABLE = rf"^(?:[\x{{00}}-\x{{7f}}]++|[\x{{ac00}}-\x{{d7a3}}]++|[{NFKC_STABLE_CLASS}]++)*+$"

# --- fixed values: text cleaning ----------------------------------------------------------
CLEAN_PATTERNS = (
    rf"\[별표{S}*{D}*\]",
    rf"\[별지{S}*제?{D}*호?{S}*서식?\]",
    rf"\[시행{S}*[{D}\.{WS_CLASS}]+\]",
    rf"\[법률{S}*제{D}+호\]",
    rf"<표{S}*{D}*>",
    rf"<그림{S}*{D}*>",
)
CONTROL_CLASS = r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{7f}-\x{9f}]"
SPACE_LIKE_CLASS = r"[\x{a0}\x{3000}\t]"
BULLET_CLASS = r"[\x{2022}\x{25a0}\x{25cb}\x{2013}\x{2014}]"

# --- fixed values: citations --------------------------------------------------------------
ARTICLE = rf"제{S}*{D}+{S}*조(?:의{S}*{D}+)?"
PARENTHESES = r"\([^)]+\)"
EDGE_JUNK_MARKS = "'’`“”,;·ᆞ•및또는"
EDGE_JUNK = rf"[{EDGE_JUNK_MARKS}{WS_CLASS}]+"
LAW_CHARS = r"가-힣A-Za-z0-9·\-~"
LAW_WORD = rf"[{LAW_CHARS}]+"
BRACKETED_LAW = r"「([^」]+)」$"
LAW_ENDING = "(?:법|법률|규칙|규정|령|칙|조례|헌법)"
COMPOUND_LAW = rf"((?:{LAW_WORD}(?::{S}+{LAW_WORD})*)?{LAW_ENDING})$"
WORD_LAW = rf"({LAW_WORD})$"
LAW_STOP_WORDS = ("및", "또는", "과", "와", "제", "각")
SUBUNIT_ONLY = rf"^제?{D}*(?:항|호|목)$"
INCOMPLETE_LAW = rf"^제?{D}+조"
INVALID_LAW_KEYWORDS = (
    "및", "또는", "과", "와", "제", "각", "동", "상기",
    "따라", "의해", "의한", "종전", "동법", "해당", "전단", "후단",
)
SUFFIX_LAWS = ("시행령", "시행규칙", "규칙", "령", "동법시행령", "동법시행규칙")
STANDALONE_LAWS = ("법", "법률", "동법")
INCOMPLETE_WORDS = ("제", "조")
BARE_CITATION_WORDS = ("법", "제", "조")
SUBORDINATE_MARKS = ("시행령", "시행규칙")
POINTER_WORDS = ("전단", "후단", "따라", "의해", "종전")
LEADING_CITATION = rf"^([{LAW_CHARS}{WS_CLASS}]+제{D}+조(?:의{D}+)?)"
VALID_LAW_SUFFIX = rf"(?:법|법률|규칙|규정|령|칙|조례|헌법|제{D}+조(?:의{D}+)?)$"
ARTICLE_START = rf"^제{D}+조"

LAW_NAME_BODY = (
    rf"[가-힣]+(?:{S}+[가-힣]+){{0,5}}{S}+에{S}+관한{S}+[가-힣]*(?:법|법률)"
    rf"|[가-힣]{{2,10}}{S}+[가-힣]{{2,10}}(?:법|법률|규정|규칙|령|조례)"
    r"|[가-힣]{2,12}(?:법|법률|규정|규칙|령|조례)"
)
LAW_NAME_PAREN = rf"(?:{S}*[\(（][^\)）]*[\)）])?"
NOT_LAW_NAMES = ("한글맞춤법", "표준어규정", "외래어표기법")
NOT_LAW_SUFFIXES = (
    "방법", "수법", "기법", "불법", "합법", "위법", "적법", "준법", "탈법", "사법", "입법",
)
LAW_REF = rf"[가-힣]+법(?:{S}*시행령|{S}*시행규칙)?{S}*제{D}+조(?:의{D}+)?"

# --- fixed values: chunking ---------------------------------------------------------------
SECTION_HEAD = rf"제{S}*{D}+{S}*조(?:{S}*의{S}*{D}+)?"
SECTION_TITLE = rf"{S}*\([^)]+\)"
SENTENCE_ENDS = "[.!?。]"
MAX_CHARS, OVERLAP_CHARS, MIN_CHARS = 1600, 100, 20
CORPUS_MIN_CHARS = 30
SAMPLE_CHUNKS, SAMPLE_TEXT_CHARS = 10, 8000

# --- fixed values: dates ------------------------------------------------------------------
REVISION_KEYWORDS = (
    rf"(?:개정|시행|제정|공포|최종{S}*수정|last{S}*revised|amended|effective)"
)
# how those keywords begin: a cheap test before the full one
REVISION_LEADS = "(?:[개시제공최]|[lL][aA]|[aA][mM]|[eE][fF])"
DATE_PATTERNS = (
    rf"({D}{{4}}){S}*년{S}*({D}{{1,2}}){S}*월{S}*({D}{{1,2}}){S}*일",
    rf"({D}{{4}})\.{S}*({D}{{1,2}})\.{S}*({D}{{1,2}})",
    rf"({D}{{4}})-({D}{{2}})-({D}{{2}})",
    rf"({D}{{4}})/({D}{{2}})/({D}{{2}})",
)
KEYWORD_BEFORE, KEYWORD_AFTER = 50, 150

# --- fixed values: document kinds ---------------------------------------------------------
DOC_TYPES = ("pdf", "pptx", "docx", "hwp", "hwpx", "ppt", "txt", "xlsx")
FILE_TYPES = {
    ".pdf": "PDF", ".hwp": "HWP", ".hwpx": "HWP", ".docx": "DOCX",
    ".ppt": "PPT", ".pptx": "PPT", ".xlsx": "XLSX", ".txt": "TXT",
}
CATEGORIES = (
    "법령·규정", "계약서·협약서", "판결문·결정문", "행정문서·공문", "보고서·연구자료",
    "회의록·의사록", "매뉴얼·지침서", "재무·회계문서", "기술문서", "기타",
)
DEFAULT_CATEGORY = "기타"
STRUCTURED_CATEGORIES = ("법령·규정", "판결문·결정문", "계약서·협약서")
UNSTRUCTURED_CATEGORIES = ("행정문서·공문", "보고서·연구자료")
PLACEHOLDER_TITLES = ("", "새대화", "새 대화", "New Chat")

# --- fixed values: corpus -----------------------------------------------------------------
CORPUS_TYPES = ("법령", "판결문", "결정례", "해석례")
CORPUS_TASKS = ("QA", "SUM")
SOURCE_ID_COLUMN = {
    "법령": "법령일련번호", "판결문": "판례일련번호",
    "결정례": "결정례일련번호", "해석례": "해석례일련번호",
}
INFO_ID_KEY = {
    "법령": "lawId", "판결문": "precedId", "결정례": "determintId", "해석례": "interpreId",
}
SOURCE_FOLDER_PREFIX, LABEL_FOLDER_PREFIX = "TS_", "TL_"
SEQ_COLUMN, CONTENT_COLUMN = "문장번호", "내용"
CITED_TYPES = ("해석례", "판결문", "결정례")
DATE_FIELDS = ("promulgDate", "effectDate", "sentenceDate", "finalDate", "interpreDate")
MISSING_ID = "000000"
MIN_LABEL_CHARS = 5
MIN_TEXT_CHARS = 20

# --- fixed values: retrieval --------------------------------------------------------------
PUBLIC_NAMESPACE, USER_NAMESPACE_PREFIX = "public", "user_"
SPARSE_THRESHOLD = 0.15
ALPHA = 0.7
TOP_K, PROMPT_K, HISTORY_TURNS = 5, 3, 10
GATE_THRESHOLD, SYNC_THRESHOLD = 0.6, 0.75
GATE_PROBE_K = 3
DOCUMENT_SHARE = 0.6

WARNING_TAIL = "'는 참고 자료에서 직접 확인되지 않았습니다. 정확하지 않을 수 있습니다."
REFERENCE_TITLE = "[참고자료]"
NO_REFERENCE = "관련 자료를 찾을 수 없습니다."
NO_CONTENT = "본문 내용 없음"
QUESTION_TITLE = "[질문]"
UPLOAD_TITLE, PUBLIC_TITLE = "업로드 문서", "법령/판례"
EXCERPT_CHARS, TITLE_CHARS, PREVIEW_CHARS = 120, 20, 60

# --- fixed values: page blocks ------------------------------------------------------------
MIN_REGION_WIDTH, MIN_REGION_HEIGHT = 40, 25
LINE_THRESHOLD = 20.0

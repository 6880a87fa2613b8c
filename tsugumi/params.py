"""Named settings of indexing and retrieval. Every function takes them as parameters; these are the defaults."""

# Limits, weights and tables that results depend on.
MAX_CHUNK_BYTES = 800
MAX_MESSAGE_CHARS = 800
MIN_MESSAGE_CHARS = 10
SNIPPET_CHARS = 200
RRF_K = 60.0
SCORE_THRESHOLD = 0.005
ENTITY_WEIGHT = 1.0
CANDIDATES_PER_RESULT = 3
MAX_EXPANSIONS = 5
RELATED_ENTITIES = 5
RELATED_DOCUMENTS = 5
BM25_K1, BM25_B, BM25_MIN_IDF = 1.2, 0.75, 1e-6
HALF_LIFE_DAYS = {"note": 120.0, "research": 60.0, "session": 30.0}
DEFAULT_HALF_LIFE_DAYS = 90.0
SESSION_WEIGHT = 0.3
UNDATED_DECAY = 0.5
STATUS_PENALTY = {"superseded": 0.2, "rejected": 0.3, "dropped": 0.3, "outdated": 0.4}
RANKER_WEIGHTS = {"Keyword": (1.5, 0.5), "Question": (0.5, 1.5), "EntityFocused": (1.2, 0.8), "Fuzzy": (0.0, 1.0), "Default": (1.0, 1.0)}
QUESTION_PATTERNS = ("とは", "の方法", "のやり方", "どうやって", "どうすれば", "どのように", "なぜ", "どうして", "ですか", "でしょうか", "って何", "とは何", "について", "の違い", "の比較")
SYNONYMS_PER_TOKEN, SYNONYM_THRESHOLD = 3, 0.3
SYNONYM_CAP, SYNONYM_LEARNED, SYNONYM_STALE_DAYS = 0.9, 0.05, 180
SYNONYM_HALF_LIFE = {"feedback": 90.0, "chat": 60.0}
SYNONYM_TIMELESS = ("wordnet", "user")
SYNONYM_OTHER_HALF_LIFE = 90.0
NOUNS_PER_MESSAGE = 30
TAG_STRENGTH = 0.7
ENTITY_LINKS_PER_DOCUMENT, ENTITY_LINK_CAP, ENTITY_LINK_FLOOR = 20, 0.6, 0.05
DICTIONARY_THRESHOLD = 5
RECENT_DAYS = 30
ENCODE_BYTES = 8192
SOURCE_TYPES = {"notes": "note", "ideas": "idea", "updates": "update", "products": "product", "decisions": "decision", "retrospectives": "retrospective"}

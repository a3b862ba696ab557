"""Formats, keys and tables that outputs must agree on."""

# --- fixed values: marker texts of message lines (case-sensitive prefilter) ---
RX_MARKER = "SomeipCOmm :: RX Message"
TX_MARKER = "TX Message SomeipComm::send"

# --- fixed values: property name formats ---
MESSAGE_PROPERTY = r"(?i)^VHAL_(.+)$"
SIGNAL_PROPERTY = r"(?i)^(.+?)__(.+?)_(rx|tx)_v$"

# --- fixed values: catalogue sheet column positions (0-based) ---
SHEET_MESSAGE_NAME = 14
SHEET_COMPONENT = 17
SHEET_SERVICE_ID = 24
SHEET_METHOD_ID = 25
SHEET_MESSAGE_TYPE = 26
SHEET_SIGNAL_NAME = 28

CAN_COMPONENT = "CANNetwork"
CAN_FRAME_PREFIX = "CANRXFrame"

# --- fixed values: request sizes of the line scorer ---
BATCH_LINES = 8
MIN_BUDGET = 150
MAX_BUDGET = 700
BUDGET_OFFSET = 95

# --- fixed values: half-width of a log window, page size of the name search ---
WINDOW_SECONDS = 5
SEARCH_LIMIT = 100

# --- fixed values: bytes of a frame before the signal area (id, id, status) ---
FRAME_HEADER_BYTES = 3

# --- fixed values: texts of definition results ---
NOTE_CAN_NEEDS_SIGNAL = (
    "isCAN is true; signal-level lookup requires a signal-typed propertyname."
)
ERROR_NOT_FOUND = "not found"

# --- fixed values: sample text headers and answers ---
INSTRUCTION_HEADER = "### Instruction:"
INPUT_HEADER = "### Input:"
RESPONSE_HEADER = "### Response:"
NOT_A_MESSAGE = "not_someip"
IGNORE_TYPE = "ignore"
SAMPLE_TYPES = ("rx", "tx", "not_someip", "parse_error")

# --- fixed values: payload size classes, as (label, inclusive upper bound) ---
SIZE_CLASSES = (
    ("1-10", 10),
    ("11-20", 20),
    ("21-50", 50),
    ("51-100", 100),
    ("101-150", 150),
    ("151-200", 200),
    ("201-240", None),
)
BIG_PAYLOAD_BYTES = 201

# --- fixed values: samples wanted per stratum ---
STRATUM_QUOTAS = {
    "rx_big": 300,
    "tx_big": 100,
    "rx_known": 400,
    "rx_other": 200,
    "tx_any": 300,
    "ignore": 200,
}

# --- fixed values: (service, method) pairs known from real logs ---
KNOWN_RX_PAIRS = (
    (0xC7, 0x80E5), (0xC7, 0x80E2), (0xC7, 0x80DF), (0xC7, 0x80E3),
    (0xC0, 0x8000), (0xC0, 0x8001), (0xC0, 0x8002), (0xC0, 0x8003),
    (0xC0, 0x8004), (0xC0, 0x8005), (0xC0, 0x8006),
    (0xBF, 0x800D), (0xBF, 0x800F), (0xBF, 0x8012), (0xBF, 0x8013),
    (0xBF, 0x8014), (0xBF, 0x8017), (0xBF, 0x801B), (0xBF, 0x801C),
    (0xBF, 0x8022), (0xBF, 0x8023), (0xBF, 0x8024), (0xBF, 0x8025),
    (0xBF, 0x8027), (0xBF, 0x802A), (0xBF, 0x802B), (0xBF, 0x802C),
    (0xBF, 0x802D), (0xBF, 0x802E), (0xBF, 0x802F), (0xBF, 0x8030),
    (0xBF, 0x8031), (0xBF, 0x8032), (0xBF, 0x8033), (0xBF, 0x8034),
    (0xBF, 0x8035), (0xBF, 0x8036), (0xBF, 0x8037), (0xBF, 0x803A),
    (0xBF, 0x803B), (0xBF, 0x803D), (0xBF, 0x8044), (0xBF, 0x8045),
    (0xBF, 0x8046), (0xBF, 0x8051), (0xBF, 0x8055), (0xBF, 0x8057),
    (0xBF, 0x8058), (0xBF, 0x8059), (0xBF, 0x805A), (0xBF, 0x805C),
    (0xBF, 0x805F), (0xBF, 0x806B),
    (0xCA, 0x80E4), (0xCB, 0x8007), (0xCB, 0x800A),
    (0xCF, 0x8000), (0xC5, 0x80DF),
    (0x102, 0x8000), (0xDA, 0x8000),
)
KNOWN_TX_PAIRS = (
    (193, 4), (193, 3), (194, 1), (196, 12), (198, 1),
    (287, 24585), (288, 1), (290, 3),
)

"""Fixed values of the scoring rules."""

# Upper ends of the normalised ranges.
MAX_AMOUNT = 10_000.0
MAX_INSTALLMENTS = 12.0
MAX_RATIO = 10.0
MAX_MINUTES = 1_440.0
MAX_KM = 1_000.0
MAX_TX_COUNT = 20.0
MAX_MERCHANT_AVG = 10_000.0
HOURS = 23.0
DAYS = 6.0

# Risk of a merchant category, and of any other.
MCC_RISK = {4511: 0.35, 5311: 0.25, 5411: 0.15, 5812: 0.30, 5912: 0.20, 5944: 0.45, 5999: 0.50, 7801: 0.80, 7802: 0.75, 7995: 0.85}
DEFAULT_RISK = 0.5

# Quantisation, neighbours, budgets of the search, limits of requests.
SCALE = 10_000
DIM = 14
MISSING = -10_000
K = 5
FAST, FULL = 8, 24
DECLINE_FROM = 3
MAX_KNOWN_MERCHANTS = 32
MAX_BODY = 8_192
MAX_U32 = 4_294_967_295

"""Fixed values. They must not change: results depend on them."""

# Mean and standard deviation behind the z-scores of the fact table.
SCALING = {
    "rainfall": (782.7453, 925.3081),
    "min_price": (1563.7877, 1029.2886),
    "max_price": (1865.0167, 1194.8210),
}

# Scaled inputs of a prediction whose key has no history.
DEFAULT_SCALED = {"rainfall": 0.0, "min_price": -1.0, "max_price": 1.0}

# Raw min, max and modal price where no commodity matches at any level.
DEFAULT_PRICES = {"min": 1800.0, "max": 2200.0, "modal": 2000.0}

# Yield per hectare where neither the district, the state nor the crop is known.
DEFAULT_YIELD = 0.5

# Market commodities that price a crop, in order of preference.
CROP_ALIASES = {
    "rice": ["paddy", "rice"],
    "paddy": ["paddy", "rice"],
    "wheat": ["wheat", "atta", "maida"],
    "potato": ["potato"],
    "jute": ["jute"],
    "maize": ["maize"],
    "onion": ["onion"],
    "turmeric": ["turmeric"],
    "ginger": ["ginger", "dry ginger"],
    "dry ginger": ["dry ginger", "ginger"],
    "dry chillies": ["dry chillies", "red chillies", "chilli"],
    "coconut": ["coconut"],
    "garlic": ["garlic"],
    "gram": ["gram", "bengal gram", "kabuli gram"],
    "blackgram": ["black gram", "urad", "blackgram"],
    "urad": ["urad", "black gram"],
    "moong(green gram)": ["green gram", "moong"],
    "masoor": ["masur", "lentil", "masoor"],
    "arhar/tur": ["arhar", "pigeon pea", "red gram"],
    "rapeseed &mustard": ["mustard", "rape & mustard"],
    "sesamum": ["sesamum", "til"],
    "sugarcane": ["sugarcane", "gur"],
}

# Rainfall column of each season; any other season uses the annual total.
SEASON_RAIN = {
    "Kharif": "JJAS",
    "Rabi": "OND",
    "Whole Year": "ANNUAL",
    "Autumn": "OND",
    "Summer": "MAM",
    "Winter": "JF",
}
ANY_SEASON_RAIN = "ANNUAL"

MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
SEASON_TOTALS = ["JF", "MAM", "JJAS", "OND", "ANNUAL"]

# Order in which rainfall columns are ranked; it decides ties.
RAIN_COLUMNS = [*MONTHS, "ANNUAL", "JF", "MAM", "JJAS", "OND"]

COLD_START_STATES = ("ASSAM",)
PREFERRED_GRADE = "FAQ"
GENERIC_VARIETY = "local"

# Synthetic history: year, yield factor, price factor.
SYNTHETIC_HISTORY = [
    (2020, 0.88, 0.90),
    (2021, 0.94, 0.93),
    (2022, 0.90, 0.96),
    (2023, 1.05, 1.03),
    (2024, 1.0, 1.0),
]
SYNTHETIC_YIELD = 0.2

# Tokens the price, rainfall and production files use for a missing value.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Reason texts of a rejected request.
BAD_AREA = "Area must be a valid number"
BAD_DATE = "Year and Month must be numbers"
BAD_RAINFALL = "Rainfall must be a valid number"
BAD_PRICE = "Prices must be numbers"

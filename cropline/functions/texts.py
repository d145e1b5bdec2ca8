"""Labels and sentences of the insight columns.

``%s`` stands for a value of the row, in the order the caller names them.
"""

BELOW, NORMAL, ABOVE = "Below Average Rainfall", "Normal Rainfall", "Above Average Rainfall"
RAIN_LIMIT = 0.3
RAIN_SENTENCES = {
    BELOW: (
        "Expected seasonal rainfall of %s mm is below the regional average of 782.7 mm. "
        "This deficit of moisture reduces the expected crop growth and lowers yield potential."
    ),
    NORMAL: (
        "Expected seasonal rainfall of %s mm matches regional baseline averages (782.7 mm). "
        "Normal weather conditions support steady crop development."
    ),
    ABOVE: (
        "Expected seasonal rainfall of %s mm is above the regional average of 782.7 mm. "
        "The abundant moisture supports strong vegetation growth, which optimizes crop yield."
    ),
}

# Values: area, rainfall, rainfall class, crop, district, state.
PLAIN_EXPLANATION = (
    "Our model determines this estimate based on three core features. "
    "First, your **Farm Size of %s Hectares** scales the total output volume. "
    "Second, the **expected rainfall of %s mm** (%s) determines crop growth conditions. "
    "Finally, the historical performance baseline of **%s** in **%s, %s** sets the regional average."
)
# Values: area, area weight, rainfall z-score, rainfall weight, crop, district, state, base weight.
TECHNICAL_EXPLANATION = (
    "Our tree-boosted model splits feature attributions mathematically: "
    "First, the **Farm Size of %s Hectares** scales the production volume, "
    "contributing **%s%%** of the yield output. "
    "Second, **Rainfall conditions (Z-score index: %s)** accounts for **%s%%** of the estimate. "
    "Finally, the historical performance of **%s** in **%s, %s** "
    "establishes a **%s%%** soil and climate baseline."
)

INCREASING, STABLE, DECREASING = "Increasing Trend", "Stable Trend", "Decreasing Trend"
TREND_LIMIT = 50

BOUND_LOW, BOUND_HIGH = 0.88, 1.12

# Influence weights in percent: floor, highest addition and factor; then the
# split used where the two would leave too little for the base.
AREA_WEIGHT = (48, 20, 1.2)
RAIN_WEIGHT = (18, 22, 12)
WEIGHT_LIMIT = 94
CAPPED_WEIGHTS = (58, 28)
DEFAULT_AREA = 10.0

VERY_HIGH, HIGH, MODERATE = "Very High Influence", "High Influence", "Moderate Influence"
MEDIUM, LOW, BASELINE = "Medium Influence", "Low Influence", "Baseline Influence"

# Rows of the valuation report, in order.
REPORT_ROWS = {
    "plain": (
        "Predicted Crop Yield",
        "Market Price (Modal)",
        "Expected Yearly Revenue",
        "Revenue Bounds",
        "Farm Scale Influence",
        "Rainfall & Weather Impact",
        "Soil & Local Suitability Baseline",
        "Market Trend",
        "Cultivated State",
        "Cultivated District",
        "Crop Commodity",
        "Cultivation Season Cycle",
        "Land Area Profile",
        "Expected Rainfall",
        "Assumed Product Grade",
        "Assumed Market Center",
        "Crop Variety Profile",
        "Expected Price Range",
    ),
    "technical": (
        "Predicted Crop Yield",
        "Market Price (Modal)",
        "Expected Yearly Revenue",
        "Revenue Bounds",
        "Farm Scale Influence",
        "Rainfall & Weather Impact",
        "Soil & Local Suitability Baseline",
        "Market Trend",
        "Cultivated State",
        "Cultivated District",
        "Crop Commodity",
        "Cultivation Season Cycle",
        "Land Area Profile",
        "Rainfall Standard Index",
        "Assumed Product Grade",
        "Assumed Market Center",
        "Crop Variety Profile",
        "Price Model Min Spec (Scaled)",
        "Price Model Max Spec (Scaled)",
        "Engine Execution Latency",
    ),
}

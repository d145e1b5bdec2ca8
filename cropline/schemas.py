"""Table layouts. Sources read by these names and never infer types."""

from pyspark.sql import types as T


def _table(spec: str) -> T.StructType:
    kinds = {"s": T.StringType(), "d": T.DoubleType(), "i": T.IntegerType(), "l": T.LongType(), "t": T.TimestampType()}
    fields = [field.split(":") for field in spec.split()]
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in fields])


AGRI = _table(
    "State:s District:s Year:i Season:s Crop:s Area:d Production:d SUBDIVISION:s "
    "Rainfall:d Modal_Price:d Min_Price:d Max_Price:d"
)
PRODUCTION = _table("State_Name:s District_Name:s Crop_Year:i Season:s Crop:s Area:d Production:d")
PRICES = _table(
    "State:s District:s Market:s Commodity:s Variety:s Grade:s Month:i Min_Price:d Max_Price:d Modal_Price:d"
)
RAINFALL = _table(
    "SUBDIVISION:s YEAR:i JAN:d FEB:d MAR:d APR:d MAY:d JUN:d JUL:d AUG:d SEP:d OCT:d NOV:d DEC:d "
    "ANNUAL:d JF:d MAM:d JJAS:d OND:d"
)
PREDICTION_LOG = _table(
    "id:l username:s timestamp:t crop:s state:s district:s season:s area:d rainfall:d "
    "predicted_yield:d predicted_price:d total_value:d latency_ms:d status:s"
)
AUTH_EVENTS = _table("id:l username:s action:s ip_address:s timestamp:t")
AUTH_ACTIONS = ("LOGIN_SUCCESS", "LOGIN_FAILURE", "LOGOUT", "REGISTER")

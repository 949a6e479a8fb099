"""Fixed values that must equal the behaviour being reproduced.

These are data, not logic: thresholds, labels, bands and orders that decide
results. They are stated plainly, in their natural order, in one place.
"""

# --- Fixed values: quality-score ranges per parameter (min, max) -----------
QUALITY_THRESHOLDS: dict[str, tuple[float, float]] = {
    "pm25": (0.0, 500.0),
    "pm10": (0.0, 600.0),
    "no2": (0.0, 200.0),
    "so2": (0.0, 1000.0),
    "o3": (0.0, 400.0),
    "co": (0.0, 50.0),
}
UNKNOWN_PARAMETER_SCORE = 0.5
TRUSTED_SCORE_ABOVE = 0.5

# --- Fixed values: display labels of parameter codes -----------------------
PARAMETER_LABELS: dict[str, str] = {
    "pm1": "PM1",
    "pm25": "PM2.5",
    "pm10": "PM10",
    "co": "CO",
    "co2": "CO2",
    "no": "NO",
    "no2": "NO2",
    "so2": "SO2",
    "o3": "O3",
    "nh3": "NH3",
    "voc": "VOC",
    "pb": "Lead (Pb)",
    "temperature": "Temperature",
    "humidity": "Humidity",
    "pressure": "Pressure",
    "windspeed": "Wind Speed",
    "winddirection": "Wind Direction",
    "rain": "Rain",
    "visibility": "Visibility",
    "uvi": "UV Index",
}

# --- Fixed values: AQI bands (low, high inclusive, label, colour) ----------
AQI_BREAKPOINTS: list[tuple[float, float, str, str]] = [
    (0, 50, "Good", "#22c55e"),
    (51, 100, "Moderate", "#eab308"),
    (101, 150, "Unhealthy for Sensitive Groups", "#f97316"),
    (151, 200, "Unhealthy", "#ef4444"),
    (201, 300, "Very Unhealthy", "#8b5cf6"),
    (301, 500, "Hazardous", "#7f1d1d"),
]
AQI_NO_READING = ("No reading", "#94a3b8")
AQI_OUT_OF_BANDS = ("Hazardous", "#7f1d1d")
AQI_SCALE_MAX = 500.0

# --- Fixed values: wide-row parameter columns, in display order ------------
POLLUTANT_ORDER: list[str] = [
    "pm1", "pm25", "pm10", "co", "co2", "no", "no2", "so2", "o3", "nh3",
    "voc", "pb", "temperature", "humidity", "pressure", "windspeed",
    "winddirection", "rain", "visibility", "uvi",
]

# --- Fixed values: parameters of the gen 1 latest-values pivot -------------
LATEST_PIVOT_PARAMETERS: list[str] = ["pm10", "pm25", "so2"]

# --- Fixed values: weekday names, Monday first -----------------------------
WEEKDAY_ORDER: list[str] = [
    "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday",
]

# --- Fixed values: payload columns that get another name --------------------
PAYLOAD_RENAMES = {
    "locationsId": "location_id",
    "sensorsId": "sensor_id",
    "datetime": "measurement_time",
    "location": "location_name",
}

# --- Fixed values: limits and periods ---------------------------------------
QUALITY_STALE_HOURS = 24
RAW_TABLE_CANDIDATES = ("air_quality", "air_quality_data")
EXPORT_MAX_ROWS = 100_000
LATEST_PAGE_DEFAULT, LATEST_PAGE_MAX = 100, 1000
DAILY_PAGE_DEFAULT, DAILY_PAGE_MAX = 1000, 10000
TREND_SERIES_CAP = 1000
SEARCH_LIMIT = 50
TOP_LOCATIONS = 12
PAYLOAD_LATEST_LIMIT = 100
LOCATION_LISTING_LIMIT = 1000
SOURCE_NAME = "openaq"
OUTLIER_IQR_FACTOR = 1.5
OUTLIER_Z_LIMIT = 3.0
EXPORT_FORMATS = ("csv", "json", "parquet")

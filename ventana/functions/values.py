"""Fixed values that results must carry unchanged (labels, limits, advice).

These are data, not logic: they are the label texts, thresholds and lookup
entries the dashboards, API and notebooks print, stated here in their natural
order so that every operator uses one copy.
"""

# --- fixed values -----------------------------------------------------------

# Three-level PM2.5 label (upper bounds inclusive, last level catches the rest).
LEVEL3_BOUNDS = [12.0, 35.5]
LEVEL3_LABELS = ["Bon", "Moyen", "Mauvais"]

# Four-level label with advice used by the forecast service (35, not 35.5).
LEVEL4_BOUNDS = [12.0, 35.0, 55.0]
LEVEL4_LABELS = ["Bon", "Modéré", "Mauvais", "Très Mauvais"]
LEVEL4_ADVICE = [
    "L'air est pur. Idéal pour les activités extérieures.",
    "Qualité acceptable. Les personnes très sensibles devraient limiter les efforts prolongés.",
    "Port du masque recommandé près des grands axes (Étoile Rouge, Dantokpa).",
    "Alerte pollution. Limitez les sorties non essentielles.",
]

# Label of the larger of PM10 and PM2.5 (notebook variant).
LEVEL_MAX_BOUNDS = [12.0, 35.5]
LEVEL_MAX_LABELS = ["Bon", "Modéré", "Mauvaise"]

# Label of a mean index value.
INDEX_BOUNDS = [50.0, 100.0]
INDEX_LABELS = ["Bon", "Modéré", "Mauvais"]

# Dominant level: name used when the "bad" / "moderate" share passes 50 %.
DOMINANT_LABELS = ["Mauvais", "Modéré", "Bon"]

# Seasons: months of the dry season, and the two names.
DRY_MONTHS = [12, 1, 2]
SEASON_DRY = "Harmattan (Déc-Fév)"
SEASON_WET = "Saison pluvieuse (Mar+)"

# Rain intensity classes of a positive amount: <1, <3, else.
RAIN_BOUNDS = [1.0, 3.0]
RAIN_CLASSES = ["blue", "teal", "coral"]

# Month labels of the dashboard (months without an entry stay unlabelled).
MONTH_LABELS = {9: "Sept 2025", 10: "Oct 2025", 11: "Nov 2025", 12: "Déc 2025",
                1: "Jan 2026", 2: "Fév 2026", 3: "Mar 2026"}

# Short names of measures for correlation matrices.
SHORT_NAMES = {"pm10": "PM10", "pm2_5": "PM2.5", "carbon_monoxide": "CO",
               "carbon_dioxide": "CO2", "sulphur_dioxide": "SO2", "ozone": "O3",
               "nitrogen_dioxide": "NO2", "methane": "CH4", "european_aqi": "AQI",
               "formaldehyde": "CH2O"}

# Health-guideline limits per measure (µg/m³), and the limit of the mean index.
GUIDELINE_LIMITS = {"pm2_5": 12.0, "pm10": 40.0, "ozone": 100.0, "nitrogen_dioxide": 10.0}
INDEX_LIMIT = 50.0
# Gauge colour classes by value/limit ratio: >1, >0.75, else.
GAUGE_RATIO_BOUNDS = [1.0, 0.75]
GAUGE_CLASSES = ["danger", "amber", "teal"]
STATUS_OK = "OK"
STATUS_OVER = "Dépassé"
STATUS_HIGH = "Élevé"
UNIT = "μg/m³"

# Alert class chosen from a label text (tested in this order).
ALERT_RULES = [("Mauvais", "alert-bad"), ("Bon", "alert-good")]

# Episode rule: index above 60 for at least 6 consecutive rows.
EPISODE_THRESHOLD = 60.0
EPISODE_MIN_ROWS = 6
PEAK_THRESHOLD = 60.0
PEAK_TOP_N = 15

# Wind rose: 16 sectors of 22.5°, speed bins [0,5) [5,10) [10,15) [15,20) [20,50).
WIND_SECTORS = 16
WIND_SPEED_EDGES = [0.0, 5.0, 10.0, 15.0, 20.0, 50.0]
WIND_SPEED_LABELS = ["0-5", "5-10", "10-15", "15-20", ">20"]

# Digits to which results are published: key figures, daily and hourly means, correlations,
# episodes, and the shares and means that are labelled after rounding.
KPI_DIGITS = 2
MEAN_DIGITS = 3
MONTH_DIGITS = 2
CORR_DIGITS = 3
EPISODE_DIGITS = 1

# Physical range of PM2.5 used by the data-quality report.
PM25_RANGE = (0.0, 500.0)

# Retrain rule: MAE above max(1.5 * baseline MAE, 5); null share of PM2.5 above 10 %.
RETRAIN_FACTOR = 1.5
RETRAIN_FLOOR = 5.0
RETRAIN_DEFAULT_BASELINE = 2.0
RETRAIN_NULL_SHARE = 0.1
REASON_PERF = "Dégradation de la performance (MAE: {mae} > seuil {thr})"
REASON_NULLS = "Trop de données manquantes sur PM2.5 (> 10%)"

# Freshness gate: collect again when the last collection is 2 days old or more.
FRESHNESS_DAYS = 2
# Back-fill start date for a series that has no stored rows.
BACKFILL_START = "2025-09-30"

# Columns removed before the reduced hourly feature table (M3).
REDUCED_DROP = ["european_aqi_pm2_5", "carbon_monoxide", "methane", "wind_direction_10m",
                "soil_temperature_0_to_7cm", "soil_moisture_0_to_7cm", "precipitation", "rain",
                "pressure_msl", "surface_pressure"]

# Published baseline metrics of the reference model.
BASELINE_METRICS = {"mae_pm25": 2.0927, "mse_pm": 8.4486, "mae_aqi": 0.9453, "mse_aqi": 2.3403}

# Model defaults: boosted trees for the daily model, two-target hourly model.
GBT_DAILY = {"maxIter": 500, "stepSize": 0.05, "maxDepth": 5, "subsamplingRate": 0.8}
GBT_HOURLY = {"maxIter": 500, "stepSize": 0.03, "maxDepth": 6, "subsamplingRate": 1.0, "gamma": 0.1, "regAlpha": 0.1}
#: Rounds without gain after which the daily model of the notebook stops.
GBT_PATIENCE = 50

# Isolation forest defaults.
IFOREST_TREES = 100
IFOREST_SAMPLE = 256
IFOREST_CONTAMINATION = 0.05
IFOREST_SEED = 42

# Local time zone of the station (UTC+1, no daylight saving).
STATION_TZ = "Africa/Porto-Novo"
# Station coordinates added when absent.
STATION_LAT = 6.3654
STATION_LON = 2.4505

"""Parameters of the registered queries (``__spark_entry__.queries``).

Windows are chosen to cover the whole fixture history (orders 1995-01-01 ..
2001-08-01) so every registered query does work proportional to the full
tables; the one-day operators use a fixed busy day, the promotion operators
a date at which promotions are past, running and upcoming.
"""

AS_OF = "2001-08-02 00:00:00"          # end of the fixture history
FULL_DAYS = 2500                       # as_of - 2500 days < 1995-01-01
RANGE_START = "1996-01-01 00:00:00"    # closed ranges of the *_range keys
RANGE_END = "1998-12-31 23:59:59"
DAY_AS_OF = "1996-09-17 12:00:00"      # the "today" of the live-day keys
PROMO_AS_OF = "1997-06-01 00:00:00"    # promo 5 running, 1-4 past, 6-12 upcoming
PROMO_DAYS = 1500
PROMO_ID = 5
TOP_LIMIT = 10
COMPARISON = "vs_last_year"
FORECAST_HORIZON = 14
HISTORY_START = "1995-01-01 00:00:00"  # explicit whole-history range
HISTORY_END = "2001-08-01 23:59:59"
SUMMARY_START = "1998-01-01 00:00:00"  # R8: previous period covers the rest
LAYER_A = ("1996-01-01 00:00:00", "1996-12-31 23:59:59")
LAYER_B = ("1997-01-01 00:00:00", "1997-12-31 23:59:59")
CATEGORY_ID = 2
PRODUCT_ID = 7
PROMO_RANGE = ("1996-01-01 00:00:00", "2000-12-31 00:00:00")
PROMO_PERIOD = ("1996-01-01 00:00:00", "1998-12-31 23:59:59")      # A23 promotional period
NON_PROMO_PERIOD = ("1999-01-01 00:00:00", "2001-08-01 23:59:59")  # A23 comparison period

"""Constants, lists and patterns that results depend on, stated as plain text."""

from __future__ import annotations

# --- feature codes and the number of observations each needs -------------------------------------------
MIN_OBSERVATIONS = {
    "RET_1D": 2, "RET_5D": 6, "RET_10D": 11, "RET_20D": 21,
    "MOM_1M_21D": 22, "MOM_3M_63D": 64, "MOM_6M_126D": 127,
    "SMA_20": 20, "SMA_50": 50, "SMA_100": 100, "SMA_200": 200,
    "EMA_20": 20, "EMA_50": 50,
    "DISTANCE_SMA_20": 20, "DISTANCE_SMA_50": 50, "DISTANCE_SMA_200": 200,
    "RSI_14": 15, "TRUE_RANGE": 1, "ATR_14": 14, "ATR_PCT_14": 14,
    "VOLATILITY_20": 21, "VOLATILITY_60": 61,
    "AVG_VOLUME_20": 20, "AVG_VOLUME_50": 50, "VOLUME_RATIO_20": 20, "VOLUME_RATIO_50": 50,
    "AVG_TRADED_VALUE_20": 20,
    "GAP_PCT_1D": 2, "INTRADAY_RETURN": 1, "RANGE_PCT": 1, "CLOSE_LOCATION": 1,
    "ABOVE_SMA_20": 20, "ABOVE_SMA_50": 50, "ABOVE_SMA_200": 200,
    "SMA_20_ABOVE_50": 50, "SMA_50_ABOVE_200": 200,
    "PRIOR_HIGH_20": 21, "BREAKOUT_PCT_20": 21,
}
FEATURE_CODES = tuple(MIN_OBSERVATIONS)
STRUCTURE_CODES = ("PRIOR_HIGH_20", "BREAKOUT_PCT_20")
CORE_CODES = tuple(c for c in FEATURE_CODES if c not in STRUCTURE_CODES)
BOOLEAN_CODES = ("ABOVE_SMA_20", "ABOVE_SMA_50", "ABOVE_SMA_200", "SMA_20_ABOVE_50", "SMA_50_ABOVE_200")
RECURSIVE_CODES = ("EMA_20", "EMA_50", "RSI_14", "ATR_14", "ATR_PCT_14")
SESSIONS_PER_YEAR = 252

# --- clocks ---------------------------------------------------------------------------------------------
MARKET_ZONE = "Asia/Kolkata"
OPEN_FALLBACK_SECONDS = 9 * 3600 + 15 * 60
CLOSE_FALLBACK_SECONDS = 23 * 3600 + 59 * 60 + 59

# --- rule sets: (feature, operator, parameter, default, lowest, highest) ---------------------------------
RULE_SETS = {
    "MOMENTUM_TREND": (
        ("MOM_3M_63D", ">=", "min_momentum_3m", "0.10", "-1", "5"),
        ("MOM_6M_126D", ">=", "min_momentum_6m", "0.15", "-1", "10"),
        ("ABOVE_SMA_50", "=", "require_above_sma_50", True, None, None),
        ("ABOVE_SMA_200", "=", "require_above_sma_200", True, None, None),
        ("SMA_50_ABOVE_200", "=", "require_sma_50_above_200", True, None, None),
        ("VOLUME_RATIO_20", ">=", "min_volume_ratio_20", "1.00", "0", "20"),
    ),
    "BREAKOUT_20D": (
        ("BREAKOUT_PCT_20", ">=", "min_breakout_pct_20", "0.00", "-1", "5"),
        ("ABOVE_SMA_50", "=", "require_above_sma_50", True, None, None),
        ("SMA_20_ABOVE_50", "=", "require_sma_20_above_50", True, None, None),
        ("VOLUME_RATIO_20", ">=", "min_volume_ratio_20", "1.50", "0", "20"),
        ("CLOSE_LOCATION", ">=", "min_close_location", "0.70", "0", "1"),
        ("ATR_PCT_14", "<=", "max_atr_pct_14", "0.08", "0", "2"),
    ),
    "MEAN_REVERSION_PULLBACK": (
        ("RSI_14", "<=", "max_rsi_14", "35", "0", "100"),
        ("DISTANCE_SMA_20", "<=", "max_distance_sma_20", "-0.03", "-1", "2"),
        ("RET_5D", "<=", "max_return_5d", "-0.03", "-1", "5"),
        ("ABOVE_SMA_200", "=", "require_above_sma_200", True, None, None),
        ("SMA_50_ABOVE_200", "=", "require_sma_50_above_200", True, None, None),
        ("ATR_PCT_14", "<=", "max_atr_pct_14", "0.06", "0", "2"),
    ),
}
HOLDING_SESSIONS = {"MOMENTUM_TREND": 20, "BREAKOUT_20D": 20, "MEAN_REVERSION_PULLBACK": 10, "CONSENSUS": 20}
SLIPPAGE_BPS = "5"
TRADE_NOTIONAL = "100000"
MAX_EXIT_DELAY = 5

# --- cost rates -----------------------------------------------------------------------------------------
COST_RATES = {
    "stt": "0.001", "exchange": "0.0000307", "sebi": "0.000001", "gst": "0.18", "stamp_buy": "0.00015",
    "brokerage_flat": "0", "brokerage_rate": "0", "dp_sell": "0",
}

# --- regimes --------------------------------------------------------------------------------------------
REGIMES = ("TRENDING_BULL", "TRENDING_BEAR", "SIDEWAYS", "HIGH_VOLATILITY", "INSUFFICIENT_HISTORY")
VOL_WINDOW, VOL_MINIMUM, VOL_RANK = 252, 126, "0.80"

# --- financial concepts: canonical code and the labels accepted for it -----------------------------------
CONCEPT_LABELS = {
    "REVENUE": ("Revenue", "Revenue From Operations", "Income From Operations"),
    "OTHER_INCOME": ("Other Income",),
    "TOTAL_INCOME": ("Total Income",),
    "TOTAL_EXPENSES": ("Total Expenses",),
    "FINANCE_COST": ("Finance Costs", "Finance Cost"),
    "PROFIT_BEFORE_TAX": ("Profit Before Tax", "Profit Before Tax From Continuing Operations"),
    "TAX_EXPENSE": ("Tax Expense", "Total Tax Expense"),
    "PROFIT_AFTER_TAX": ("Profit After Tax", "Net Profit After Tax", "Profit For The Period", "ProfitLossForPeriod"),
    "EPS_BASIC": (
        "Basic EPS", "Basic Earnings Per Share", "BasicEarningsLossPerShareFromContinuingAndDiscontinuedOperations",
    ),
    "EPS_DILUTED": (
        "Diluted EPS", "Diluted Earnings Per Share",
        "DilutedEarningsLossPerShareFromContinuingAndDiscontinuedOperations",
    ),
    "TOTAL_ASSETS": ("Total Assets",),
    "TOTAL_EQUITY": ("Total Equity", "Total Shareholders Equity", "Equity"),
    "TOTAL_BORROWINGS": ("Total Borrowings", "Borrowings"),
    "CURRENT_BORROWINGS": ("Current Borrowings",),
    "NON_CURRENT_BORROWINGS": ("Non Current Borrowings", "Non-Current Borrowings"),
    "CASH_AND_CASH_EQUIVALENTS": ("Cash And Cash Equivalents",),
    "CASH_FLOW_FROM_OPERATIONS": (
        "Cash Flow From Operating Activities", "Net Cash From Operating Activities",
        "CashFlowsFromUsedInOperatingActivities",
    ),
    "CAPITAL_EXPENDITURE": (
        "Capital Expenditure", "Purchase Of Property Plant And Equipment",
        "PurchaseOfPropertyPlantAndEquipmentClassifiedAsInvestingActivities",
    ),
}
SECTOR_BENCHMARKS = {
    "Automobile and Auto Components": "NIFTYAUTO",
    "Fast Moving Consumer Goods": "NIFTYFMCG",
    "Financial Services": "NIFTYFIN",
    "Healthcare": "NIFTYHEALTHCARE",
    "Information Technology": "NIFTYIT",
    "Metals & Mining": "NIFTYMETAL",
    "Oil Gas & Consumable Fuels": "NIFTYOILGAS",
    "Pharmaceuticals": "NIFTYPHARMA",
    "Realty": "NIFTYREALTY",
}
RS_WINDOWS = {"RS_1M_21D": 21, "RS_3M_63D": 63, "RS_6M_126D": 126}
QUARTER_DAYS = (70, 100)

# --- artifact columns: canonical name and accepted headers, first hit wins --------------------------------
HEADERS = {
    "securities": {
        "symbol": ("TckrSymb", "Symbol", "Security Symbol"),
        "series": ("SctySrs", "Series", "Security Series"),
        "company_name": (
            "FinInstrmNm", "Company Name", "Name of Company", "Security Name", "Short Name", "Name",
        ),
        "isin": ("ISIN", "ISIN Code"),
        "listing_date": ("Date of Listing", "Listing Date", "DtOfListing"),
        "status": ("Normal Market Status", "Security Status", "Status"),
    },
    "prices": {
        "trade_date": ("TradDt", "Trade Date", "Date", "TIMESTAMP"),
        "segment": ("Sgmt", "Segment"),
        "symbol": ("TckrSymb", "Symbol"),
        "series": ("SctySrs", "Series"),
        "isin": ("ISIN", "ISIN Code"),
        "open": ("OpnPric", "Open Price", "Open"),
        "high": ("HghPric", "High Price", "High"),
        "low": ("LwPric", "Low Price", "Low"),
        "close": ("ClsPric", "Close Price", "Close"),
        "volume": ("TtlTradgVol", "Total Traded Quantity", "Volume", "TOTTRDQTY"),
        "traded_value": ("TtlTrfVal", "Turnover", "Traded Value", "TOTTRDVAL"),
    },
    "index_history": {
        "index_name": ("INDEX_NAME", "Index Name", "Index"),
        "trade_date": ("HistoricalDate", "Date", "Trade Date"),
        "open": ("OPEN", "Open"),
        "high": ("HIGH", "High"),
        "low": ("LOW", "Low"),
        "close": ("CLOSE", "Close"),
    },
    "constituents": {
        "symbol": ("Symbol", "Ticker Symbol"),
        "series": ("Series", "Security Series"),
        "isin": ("ISIN Code", "ISIN"),
        "company_name": ("Company Name", "Security Name"),
        "industry": ("Industry",),
    },
    "corporate_actions": {
        "symbol": ("Symbol",),
        "series": ("Series",),
        "purpose": ("Purpose",),
        "ex_date": ("Ex-Date", "Ex Date"),
        "record_date": ("Record Date",),
        "published_at": ("Source Published At", "Broadcast Timestamp", "Announcement Timestamp"),
    },
    "holidays": {
        "date": ("Date", "Trading Date", "Holiday Date"),
        "description": ("Description", "Holiday", "Reason"),
    },
    "fundamental_facts": {
        "symbol": ("Symbol", "TckrSymb"),
        "series": ("Series", "SctySrs"),
        "isin": ("ISIN", "ISIN Code"),
        "source_filing_id": ("Source Filing ID", "Filing ID", "Broadcast ID"),
        "supersedes_source_filing_id": ("Supersedes Filing ID", "Supersedes Broadcast ID"),
        "filing_type": ("Filing Type", "Result Type"),
        "reporting_frequency": ("Reporting Frequency", "Frequency"),
        "period_start": ("Period Start", "From Date"),
        "period_end": ("Period End", "To Date", "Quarter Ended"),
        "fiscal_year": ("Fiscal Year", "Financial Year"),
        "fiscal_quarter": ("Fiscal Quarter", "Quarter"),
        "scope": ("Scope", "Consolidated Standalone"),
        "audit_status": ("Audit Status", "Audited Unaudited"),
        "submission_at": ("Submission Timestamp", "Broadcast Timestamp", "Submitted At"),
        "source_concept": ("Concept", "Particulars", "Source Concept"),
        "value": ("Value", "Current Period Value"),
        "unit": ("Unit", "Currency"),
        "scale": ("Scale",),
        "fact_kind": ("Fact Kind", "Period Type"),
        "value_nature": ("Value Nature", "Value Type"),
        "fact_period_start": ("Fact Period Start",),
        "fact_period_end": ("Fact Period End",),
    },
    "classification": {
        "symbol": ("Symbol", "TckrSymb"),
        "series": ("Series", "SctySrs"),
        "isin": ("ISIN", "ISIN Code"),
        "macro": ("Macro Economic Sector", "Macro-Economic Sector"),
        "sector": ("Sector",),
        "industry": ("Industry",),
        "basic_industry": ("Basic Industry",),
    },
}
OPTIONAL_HEADERS = {
    "securities": ("listing_date", "status"),
    "prices": ("segment", "isin", "traded_value"),
    "index_history": (),
    "constituents": ("industry",),
    "corporate_actions": ("record_date", "published_at"),
    "holidays": (),
    "fundamental_facts": (
        "supersedes_source_filing_id", "fiscal_quarter", "fact_period_start", "fact_period_end",
    ),
    "classification": (),
}

# --- text patterns (Java regular expressions) ---------------------------------------------------------------
SYMBOL_PATTERN = r"^[A-Z0-9][A-Z0-9&._-]{0,31}$"
ISIN_PATTERN = r"^IN[A-Z0-9]{10}$"
BONUS_PATTERN = r"(?i)\bBONUS(?:\s+ISSUE)?\s*[-:]?\s*(\d+(?:\.\d+)?)\s*:\s*(\d+(?:\.\d+)?)\b"
SPLIT_PATTERN = (
    r"(?i)\b(?:SPLIT|SUB[- ]?DIVISION)\b.*?\bFROM\s+(?:RS\.?\s*)?(\d+(?:\.\d+)?)"
    r".*?\bTO\s+(?:RS\.?\s*)?(\d+(?:\.\d+)?)"
)
DATE_FORMATS = (
    ("yyyy-MM-dd", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("d-MMM-yyyy", r"^\d{1,2}-[A-Za-z]{3}-\d{4}$"),
    ("d MMM yyyy", r"^\d{1,2} [A-Za-z]{3} \d{4}$"),
    ("d MMMM yyyy", r"^\d{1,2} [A-Za-z]+ \d{4}$"),
    ("d-M-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("yyyyMMdd", r"^\d{8}$"),
)
NULL_WORDS = ("", "-", "NA", "N/A")
SEGMENTS = ("CM", "CASH", "CAPITAL MARKET")
EQUITY_SERIES = ("EQ",)
INACTIVE_STATUSES = ("SUSPENDED", "DELISTED", "INACTIVE")
MAX_VOLUME = 2**63 - 1
SAMPLE_ISSUES = 200

# --- instance documents: namespaces, supported taxonomies, unit names ------------------------------------------------
INSTANCE_NAMESPACE = "http://www.xbrl.org/2003/instance"
DIMENSION_NAMESPACE = "http://xbrl.org/2006/xbrldi"
FILING_TAXONOMIES = (
    "http://www.sebi.gov.in/xbrl/2025-01-31/in-capmkt",
    "http://www.sebi.gov.in/xbrl/2026-01-31/in-capmkt",
)
UNIT_CODES = {"INR": "INR", "PURE": "PURE", "INRPERSHARE": "INR_PER_SHARE"}

"""Published per-year counts that the fits are checked against."""

EPO_COUNTS = {
    2010: 766, 2011: 833, 2012: 872, 2013: 1043, 2014: 1252, 2015: 1370, 2016: 1643, 2017: 2009,
    2018: 2537, 2019: 3579, 2020: 5173, 2021: 6398, 2022: 7294, 2023: 8032,
}
# Counts of the years 2010 to 2023.
EU10_BY_YEAR = {
    "DE": [81, 65, 42, 49, 50, 48, 54, 64, 72, 191, 300, 414, 441, 498],
    "FR": [26, 31, 25, 34, 40, 46, 55, 79, 66, 66, 91, 125, 172, 229],
    "NL": [14, 10, 14, 21, 21, 9, 19, 26, 57, 108, 145, 161, 156, 151],
    "SE": [11, 7, 14, 12, 10, 12, 8, 18, 28, 45, 55, 88, 112, 175],
    "IT": [11, 7, 8, 8, 4, 5, 6, 8, 8, 17, 14, 28, 43, 43],
    "ES": [2, 8, 8, 11, 13, 11, 7, 6, 10, 14, 20, 20, 45, 32],
    "BE": [0, 6, 2, 8, 3, 6, 4, 7, 8, 13, 24, 22, 31, 25],
    "DK": [1, 6, 3, 3, 5, 5, 4, 4, 7, 8, 23, 24, 38, 38],
    "AT": [1, 5, 2, 1, 0, 0, 6, 5, 4, 7, 6, 10, 10, 20],
    "IE": [1, 0, 4, 9, 2, 6, 8, 2, 9, 16, 10, 18, 15, 17],
}
EU10_SLOPES = {
    "DE": 33.95, "FR": 12.53, "NL": 13.55, "SE": 9.86, "IT": 2.44, "ES": 2.13, "BE": 2.18, "DK": 2.60,
    "AT": 0.93, "IE": 1.23,
}
EU10_TOTALS = {
    "DE": 2369, "FR": 1085, "NL": 912, "SE": 595, "IT": 210, "ES": 207, "DK": 169, "BE": 159, "IE": 117, "AT": 77,
}

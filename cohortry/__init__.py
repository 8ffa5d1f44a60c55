"""Longitudinal performance analytics on Spark DataFrames.

Entities (people, accounts, products) are observed over periods in categories of
differing strength.  The package lands nested JSON and HTML into typed frames,
derives period and career rates, measures how rates carry over between ages and
categories, and trains, evaluates and applies models that rank a cohort.
"""

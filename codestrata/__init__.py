"""Structural analytics over source trees and tables of text units, as Spark DataFrames."""

"""Spark-native property-graph analytics over source trees and tables."""

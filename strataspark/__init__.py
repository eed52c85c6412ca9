"""Spark-native analytics over source trees and version-control history."""

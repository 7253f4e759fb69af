"""Operators over patches, source trees and answers."""

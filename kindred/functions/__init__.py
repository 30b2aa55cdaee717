"""Column expressions over trees and fingerprints."""
